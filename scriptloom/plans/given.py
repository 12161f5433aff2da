"""The tables that the SQL of the catalog spells out. They are parts of those of scriptloom.functions.scripts, and enough for the given data."""

BLOCKS = [
    ("basic latin", 0x0, 0x7F), ("latin-1 supplement", 0x80, 0xFF), ("latin extended-a", 0x100, 0x17F), ("latin extended-b", 0x180, 0x24F), ("ipa extensions", 0x250, 0x2AF),
    ("spacing modifier letters", 0x2B0, 0x2FF), ("combining diacritical marks", 0x300, 0x36F), ("greek and coptic", 0x370, 0x3FF), ("cyrillic", 0x400, 0x4FF), ("cyrillic supplement", 0x500, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("syriac", 0x700, 0x74F), ("arabic supplement", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F),
    ("latin extended additional", 0x1E00, 0x1EFF), ("greek extended", 0x1F00, 0x1FFF), ("general punctuation", 0x2000, 0x206F), ("currency symbols", 0x20A0, 0x20CF), ("arrows", 0x2190, 0x21FF),
    ("mathematical operators", 0x2200, 0x22FF), ("box drawing", 0x2500, 0x257F), ("cjk symbols and punctuation", 0x3000, 0x303F), ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF),
    ("cjk unified ideographs", 0x4E00, 0x9FFF), ("hangul syllables", 0xAC00, 0xD7AF), ("arabic presentation forms-a", 0xFB50, 0xFDFF), ("arabic presentation forms-b", 0xFE70, 0xFEFF), ("specials", 0xFFF0, 0xFFFF),
]
SCRIPT_BLOCKS = {
    "arabic": ["arabic", "arabic supplement", "arabic presentation forms-a", "arabic presentation forms-b"],
    "cyrillic": ["cyrillic", "cyrillic supplement"],
    "greek": ["greek and coptic", "greek extended"],
    "hiragana": ["hiragana"],
    "katakana": ["katakana"],
    "latin": ["basic latin", "latin-1 supplement", "latin extended-a", "latin extended-b", "latin extended additional"],
    "common": ["basic latin", "general punctuation", "currency symbols", "arrows"],
}
RANGES = {
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0x1EE00, 0x1EEFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "hiragana": [(0x3040, 0x309F)],
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
}
ARABIC_RULES = {0x6A9: [0x643], 0x6CC: [0x64A], 0x6C1: [0x647], 0x649: [0x64A], 0x671: [0x627], 0x677: [0x624, 0x64F], 0xFEFB: [0x644, 0x627], 0xFDFA: [0x635, 0x644, 0x649]}
