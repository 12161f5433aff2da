"""Vocabularies, encoding by two of them, decoding, sources, artifacts and commands, on literal cases and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scriptloom import __main__ as commands
from scriptloom.functions import scripts as S
from scriptloom.functions import shaping as H
from scriptloom.operators import bpe, classify, vocabulary
from scriptloom.operators.dual import DualModel, legacy_eos, token_map
from scriptloom.operators.ranks import ranked
from scriptloom.operators.vocabulary import ByteVocabulary
from scriptloom.plans import tokens as T
from scriptloom.sources import artifacts, corpora, unicode_tables


def plain_train(words, first, count):
    """Merges by recounting everything each time; of equal counts the lesser pair of ids."""
    seqs, out = [(list(ids), n) for ids, n in words], []
    for k in range(count):
        total = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        best = min(total, key=lambda p: (-total[p], p))
        out.append(best)
        new = []
        for s, n in seqs:
            to, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    to.append(first + k)
                    i += 2
                else:
                    to.append(s[i])
                    i += 1
            new.append((to, n))
        seqs = new
    return out


def plain_encode(v, word):
    ids = [v.byte_id[b] for b in word.encode()]
    while True:
        found = [(m, k) for k in range(len(ids) - 1) if (m := v.joined.get((ids[k], ids[k + 1]))) is not None]
        if not found:
            return ids
        m = min(found)[0]
        to, k = [], 0
        while k < len(ids):
            if k + 1 < len(ids) and v.joined.get((ids[k], ids[k + 1])) == m:
                to.append(m)
                k += 2
            else:
                to.append(ids[k])
                k += 1
        ids = to


def random_words(rng, n):
    return list({"".join(rng.choice("abcdé ع") for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(n)}.items())


@pytest.mark.parametrize("parts, one_task", [(1, 2_000_000), (8, 2_000_000), (1, 0), (8, 0)])
def test_training_meets_the_recount(spark, parts, one_task):
    rows = random_words(random.Random(5), 60)
    df = spark.createDataFrame([*rows, (None, 4), ("", 3)], "word string, n long").repartition(parts)
    v = vocabulary.train(df, 40, ["<s>", None, "None", ["</s>"]], one_task=one_task)
    assert v.specials == ["<s>", "</s>"]
    want = plain_train([([v.byte_id[b] for b in w.encode()], n) for w, n in rows], 258, 40)
    assert [p for p, _ in sorted(v.joined.items(), key=lambda x: x[1])] == want


def test_safe_batches_are_what_training_merges_next():
    rng = random.Random(6)
    for _ in range(40):
        words = [([rng.randint(0, 5) for _ in range(rng.randint(2, 8))], rng.randint(1, 4)) for _ in range(12)]
        total = {}
        for s, n in words:
            for p in zip(s, s[1:]):
                total[p] = total.get(p, 0) + n
        pairs = sorted(((a, b, n) for (a, b), n in total.items()), key=lambda x: (-x[2], x[:2]))
        batch = vocabulary.safe_batch(pairs, False)
        assert [x[:2] for x in batch] == plain_train(words, 100, len(batch))


def test_words_meet_the_plain_encoding():
    rng = random.Random(7)
    v = ByteVocabulary.of_pairs([], plain_train([([ByteVocabulary().byte_id[b] for b in w.encode()], n) for w, n in random_words(rng, 80)], 256, 60))
    for w, _ in random_words(rng, 200):
        assert v.encode_word(w) == plain_encode(v, w)
    assert len(v.encode_word("abcd" * 5000)) > 1000


def test_alphabet_and_lookups(spark):
    v = ByteVocabulary(["<s>"], [(b"t", b"h"), (b"th", b"e")])
    assert len(v) == 259 and v.pieces[1] == b"!" and vocabulary.printable(b" a\n") == "ĠaĊ" and vocabulary.from_printable("ĠaĊ") == b" a\n"
    assert v.token_to_id("the") == 258 and v.token_to_id("<s>") == 0 and v.token_to_id("nope", 7) == 7 and v.id_to_token(258) == "the" and v.id_to_token(999) is None
    assert v.visible(v.byte_id[32]) == "" and v.byte_ids() == range(1, 257)
    with pytest.raises(ValueError):
        ByteVocabulary([], [(b"xy", b"z")])
    bad = vocabulary.unreadable(v.table(spark)).count()
    assert bad == 128
    assert [r.id for r in vocabulary.lowest_ids(spark.createDataFrame([("a", 5), ("a", 3)], "token string, id int")).collect()] == [3]


def texts_of(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").repartition(3)


ODD = [None, "", "   \t\n ", "Hello مرحبا World", "the <|sep|>ofthe", "\U0001f600 中文 é", "كتاب book مجلة magazine", "x" * 5000, "Hello مرحبا World"]


def test_encode_and_decode_of_odd_texts(spark):
    m = T.model(spark)
    df = texts_of(spark, *ODD)
    ids = m.encode(F.col("text"))
    got = {r.i: r for r in df.select("i", ids.alias("ids"), m.decode(ids).alias("d"), m.tokens(ids).alias("t"), m.encoding(F.col("text")).alias("e")).collect()}
    assert got[0].ids is None and got[0].d is None and got[0].e is None and got[1].ids == [] and got[1].d == ""
    for i, t in enumerate(ODD):
        if t is not None:
            assert got[i].d == t and len(got[i].t) == len(got[i].ids) == len(got[i].e.attention_mask)
    assert got[3].ids == got[8].ids and set(got[4].ids) & {0, 1, 2}
    back = df.select("i", m.decode(m.encode(F.col("text")), skip_special_tokens=True).alias("d")).where("i = 4").first()
    assert back.d == " "
    none = df.where("false").select(m.encode(F.col("text")).alias("x")).collect()
    assert none == []


def test_plain_dual_encoding(spark):
    rng = random.Random(8)
    m = T.model(spark)
    rows = ["".join(rng.choice(["the", "e", "t", "ج", "ف", " ", "of", "о", "н", "1", "\n", "<|sep|>", "a"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    df = texts_of(spark, *rows)
    import re

    for r in df.select("text", m.encode(F.col("text")).alias("ids")).collect():
        want = []
        for p in re.split(r"(<\|sep\|>|the|of)", r.text):
            if p in T.SPECIALS:
                want.append(T.OLD.id_of[p])
                continue
            at, runs = None, []
            for c in p:
                kind = None if c in " \n" else 0x600 <= ord(c) <= 0x6FF
                if at is None or (kind is not None and at[0] is not None and kind != at[0]):
                    at = [kind, ""]
                    runs.append(at)
                elif at[0] is None:
                    at[0] = kind
                at[1] += c
            for kind, text in runs:
                for w in re.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+", text):
                    want += [T.NEW_TO_OLD[i] for i in plain_encode(T.NEW, w)] if kind else plain_encode(T.OLD, w)
        assert r.ids == want, r.text


def test_unmapped_ids_raise_or_drop(spark):
    broken = {k: v for k, v in T.NEW_TO_OLD.items() if v != T.NEW_TO_OLD[len(T.NEW) - 1]}
    df = texts_of(spark, "".join(p.decode() for p in T.NEW.pieces[-1:]))
    with pytest.raises(Exception, match="no id of the old vocabulary"):
        df.select(DualModel(spark, T.OLD, T.NEW, broken, specials=[]).encode(F.col("text"))).collect()
    m = DualModel(spark, T.OLD, T.NEW, broken, specials=[], on_unmapped="drop")
    assert df.select(m.encode(F.col("text")).alias("x")).first().x == []
    with pytest.raises(ValueError):
        DualModel(spark, T.OLD, T.NEW, broken, on_unmapped="maybe")


def test_split_characters_are_repaired(spark):
    old = ByteVocabulary([], [(bytes([0xE4]), bytes([0xB8]))])
    new = ByteVocabulary([], [])
    m = DualModel(spark, old, new, {i: i for i in range(256)}, specials=[])
    ids = [old.byte_id[97], 256, old.byte_id[0xAD], old.byte_id[98]]
    df = spark.createDataFrame([(ids,), ([256],), ([999, -1],), ([256, old.byte_id[0xAD]] * 50,)], "ids array<int>")
    rows = [tuple(r) for r in df.select(m.decode_basic(F.col("ids")), m.decode(F.col("ids"))).collect()]
    assert "�" in rows[0][0] and rows[0][1] == "a中b" and rows[1] == ("�", "�") and rows[2] == ("", "") and "�" in rows[3][0]


def test_lookups_and_stats(spark):
    m = DualModel(spark, T.OLD, T.OLD, {0: 0, 1: 100, 2: 200, 3: 3}, old_to_new={0: 0, 100: 1, 200: 2, 3: 3, 500: 1})
    assert m.new_to_old_id(1) == 100 and m.old_to_new_id(500) == 1 and m.is_mapped(500) and not m.is_common_token(500) and m.is_common_token(100) and m.new_to_old_id(999) is None
    s = m.stats()
    assert (s["new_size"], s["old_size"], s["mapped"], s["common"]) == (4, 5, 4, 4) and s["replacement"] == 128
    assert m.has_replacement_char(T.OLD.byte_id[200]) and not m.has_replacement_char(0)
    old, mapped = T.model(spark).target_ids()
    assert old == [] and len(mapped) == 6


def test_maps_of_tokens():
    old, new = ByteVocabulary(["<a>"], [(b"t", b"h"), (b"x", b"y"), (b"q", b"r")]), ByteVocabulary(["<a>", "<b>"], [(b"t", b"h"), (b"z", b"z")])
    got = token_map(old, new, [257, 258, 259])
    assert got[0] == 0 and got[new.token_to_id("th")] == old.token_to_id("th") and got[1] == 258 and got[new.token_to_id("zz")] == 259 and len(set(got.values())) == len(got)
    with pytest.raises(ValueError, match="reusable"):
        token_map(old, new, [257])


def test_model_inputs(spark):
    m = T.model(spark)
    one = lambda df, c: df.select(c.alias("x")).first().x
    df = spark.createDataFrame([("abc", "de")], "a string, b string")
    a, b = (one(df, m.encode(F.col(c))) for c in "ab")
    plus = lambda **k: one(df, m.encode_plus(F.col("a"), F.col("b") if k.pop("pair", False) else None, bos=7, eos=8, pad=9, **k))
    assert plus().input_ids == a and plus(add_special_tokens=True).input_ids == [7, *a, 8]
    assert plus(pair=True).input_ids == [*a, 8, *b, 8] and plus(pair=True, legacy=True).input_ids == a
    assert plus(add_special_tokens=True, max_length=2).input_ids == [7, a[0]] and plus(add_special_tokens=True, max_length=2, legacy=True).input_ids == [7, a[0], 8]
    p = plus(padding=6, multiple_of=4)
    assert p.input_ids == [*a, *[9] * 5] and p.attention_mask == [1] * 3 + [0] * 5
    t = spark.createDataFrame([([1, 2, 3], ["a", "b", "BLEND ENDING"]), ([1], ["a"]), ([], [])], "ids array<int>, t array<string>")
    assert [r.x for r in t.select(legacy_eos(F.col("ids"), F.col("t"), None).alias("x")).collect()] == [[1, 2], [1], []]
    assert t.select(legacy_eos(F.col("ids"), F.col("t"), 5).alias("x")).first().x == [1, 2, 5]
    assert one(t, H.without(F.col("ids"), [2])) == [1, 3]


def test_splits_without_specials_and_with_odd_ones(spark):
    df = spark.createDataFrame([("a\\Eb|c",), ("",), (None,)], "text string")
    assert [r.x for r in df.select(S.special_split(F.col("text"), []).alias("x")).collect()] == [["a\\Eb|c"], [], None]
    assert df.select(S.special_split(F.col("text"), ["\\E", "|"]).alias("x")).first().x == ["a", "\\E", "b", "|", "c"]
    assert [s.text for s in df.select(S.pretokenized(F.col("text"), [], "arabic").alias("x")).first().x] == ["a\\Eb|c"]
    cased = df.select(S.pretokens(F.lit("HelloWorld 12345 x\n y"), S.PRETOKEN_CASED).alias("x")).first().x
    assert "".join(cased) == "HelloWorld 12345 x\n y" and cased[:2] == ["Hello", "World"] and "123" in cased


def test_ranks(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 k").repartition(5)
    assert [r["rank"] for r in ranked(df, F.desc("k"), "id").orderBy(F.desc("k"), "id").collect()] == list(range(1000))
    assert ranked(df.where("false"), "k").count() == 0


def test_groups_of_tokens(spark):
    vocab = spark.createDataFrame([("ああ", 0), ("アあ", 1), ("中あ", 2), ("中", 3), ("aع", 4), ("—", 5), ("Ⅷα", 6), ("中ア", 7)], "token string, id int")
    table = classify.blocks(spark, merged=True)
    g = classify.token_groups(vocab, table)
    got = {r.id: r.grp.lower() for r in g.collect()}
    assert got == {0: "hiragana", 1: "katakana_hiragana", 2: "hiragana", 3: "cjk_merged", 4: "arabic_merged_latin_merged", 6: "greek_merged_number forms", 7: "katakana"}
    rows = {r.grp.lower(): r for r in classify.grouped_tokens(g, table).collect()}
    assert rows["hiragana"].ids == [0, 2] and rows["hiragana"].n == 2 and any(r.lo <= 0x3042 <= r.hi for r in rows["hiragana"].ranges)
    assert classify.reusable_total(classify.group_counts(g), ["hiragana", "nothing"]) == 2 and classify.reusable_total(classify.group_counts(g), []) == 0


def test_unicode_files(spark, tmp_path):
    (tmp_path / "Blocks.txt").write_text("# x\n\n0600..06FF; Arabic\n0000..007F; Basic Latin\n1D200..1D24F; Ancient Greek Musical Notation\n")
    (tmp_path / "Scripts.txt").write_text("0600..0604 ; Arabic # Cf\n0041 ; Latin # L&\n0030..0031 ; Common\n")
    (tmp_path / "Ext.txt").write_text("0030 ; Arab Latn # x\n")
    (tmp_path / "Alias.txt").write_text("# Script (sc)\nsc ; Arab ; Arabic\nsc ; Latn ; Latin\ngc ; L ; Letter\n")
    (tmp_path / "alias.json").write_text('{"ARAB": "Arabic"}')
    at = lambda n: str(tmp_path / n)
    assert [tuple(r) for r in unicode_tables.read_blocks(spark, at("Blocks.txt")).collect()] == [("basic latin", 0, 127), ("arabic", 0x600, 0x6FF), ("ancient greek musical notation", 0x1D200, 0x1D24F)]
    assert [r.block for r in unicode_tables.read_blocks(spark, at("Blocks.txt"), merged=True).collect()] == ["Latin_merged", "Arabic_merged", "Greek_merged"]
    scripts = unicode_tables.read_scripts(spark, at("Scripts.txt"))
    assert scripts.count() == 8
    aliases = unicode_tables.read_aliases(spark, at("Alias.txt"))
    assert {tuple(r) for r in aliases.collect()} == {("arab", "arabic"), ("latn", "latin")} and unicode_tables.read_json_aliases(spark, at("alias.json")).first().script == "arabic"
    ext = unicode_tables.read_script_extensions(spark, at("Ext.txt"))
    points = {(r.cp, r.script) for r in unicode_tables.scripts_of_points(scripts, ext, aliases).collect()}
    assert {(0x30, "arabic"), (0x30, "latin"), (0x31, "common")} <= points and unicode_tables.scripts_of_points(scripts).count() == 8
    by_block, by_script = unicode_tables.blocks_and_scripts(scripts, unicode_tables.read_blocks(spark, at("Blocks.txt")))
    assert {r.block: r.scripts for r in by_block.collect()} == {"basic latin": ["common", "latin"], "arabic": ["arabic"]} and by_script.count() == 3
    assert unicode_tables.resolved_scripts(["ARABIC", "Latn"], {"latn": "latin"}) == ["arabic", "latin"]
    with pytest.raises(ValueError, match="nope"):
        unicode_tables.resolved_scripts(["arabic", "nope"])
    r = spark.createDataFrame([([(1, 5)], [(5, 9)]), ([(1, 4)], [(5, 9)]), ([(1, 4)], [])], "a array<struct<lo:int,hi:int>>, b array<struct<lo:int,hi:int>>")
    assert [x.x for x in r.select(unicode_tables.ranges_overlap(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_ranges_at_their_ends(spark):
    inside = lambda c, s: spark.range(1).select(S.contains_script(F.lit(c), s).alias("x")).first().x
    assert inside(chr(0x600), "arabic") and inside(chr(0x6FF), "arabic") and not inside(chr(0x5FF), "arabic") and not inside(chr(0x700), "arabic") and inside("é", "latin") and not inside("1 ", "arabic")


def test_corpora(spark, tmp_path):
    a, b = (spark.createDataFrame([(t,)], "text string") for t in ("one", "two"))
    a.write.parquet(f"{tmp_path}/c/x/train")
    b.write.json(f"{tmp_path}/c/y/train")
    assert sorted(r.text for r in corpora.read_corpus(spark, f"{tmp_path}/c").collect()) == ["one", "two"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no dataset"):
        corpora.read_corpus(spark, f"{tmp_path}/empty")
    every = corpora.of_splits({"train": a, "test": b})
    corpora.write_cleaned(every, f"{tmp_path}/out")
    assert {r.split for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"train", "test"}
    chats = spark.createDataFrame([([("user", "hi"), ("assistant", "é")],), ([("user", None)],), (None,)], "messages array<struct<role:string,content:string>>")
    kept, rejected = corpora.clean_messages(chats, "é")
    assert kept.count() == 2 and rejected.count() == 1 and corpora.is_conversational(chats) and not corpora.is_conversational(a) and corpora.texts(chats).count() == 3
    entry = a.select(corpora.reject_entry(F.lit("train"), F.lit(3), F.array(F.lit("b"), F.lit("a")), F.col("text")).alias("x")).first().x
    assert entry == "Split: train\nIndex: 3\nDetected Languages: a, b\nText: one\n" + "-" * 80


def test_maps_and_counts_in_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1": 10, "x": 5, "2": 20}')
    assert {tuple(r) for r in artifacts.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {(1, 10), (2, 20)}
    with pytest.raises(Exception, match="no whole number"):
        artifacts.read_json_map(spark, str(tmp_path / "m.json"), strict=True).collect()
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "grp string, n long")
    artifacts.write_group_counts(counts, f"{tmp_path}/g")
    assert [tuple(r) for r in artifacts.read_group_counts(spark, f"{tmp_path}/g").collect()] == [("c", 1), ("a", 2), ("b", 2)]
    (tmp_path / "h.tsv").write_text("a\t1\nbroken\nb\tx\nc\t3\t4\n")
    assert [tuple(r) for r in artifacts.read_group_counts(spark, str(tmp_path / "h.tsv")).collect()] == [("a", 1)]


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("# settings\noutput_dir: /tmp/o\ntraining_data_dir: '/tmp/t'\nvocab_size: 300 # small\ntarget_scripts:\n  - Arabic\npreserved_scripts: [latin, Greek]\nspecial_tokens: [null, 'None', <s>]\napply_threshold: true\n")
    c = artifacts.Config.from_file(str(tmp_path / "c.yaml"))
    assert (c.vocab_size, c.target_scripts, c.preserved_scripts, c.special_tokens, c.apply_threshold) == (300, ["arabic"], ["latin", "greek"], ["<s>"], True)
    for wrong in ({"vocab_size": 0}, {"vocab_size": True}, {"output_dir": ""}, {"target_scripts": []}, {"target_scripts": ["zzz"]}, {"special_tokens": "x"}):
        with pytest.raises(ValueError):
            artifacts.Config(**({"output_dir": "o", "training_data_dir": "t"} | wrong))
    (tmp_path / "d.json").write_text('{"output_dir": "o", "training_data_dir": "t", "nope": 1}')
    with pytest.raises(ValueError, match="nope"):
        artifacts.Config.from_file(str(tmp_path / "d.json"))
    log = artifacts.logger("test-log", str(tmp_path / "logs"))
    assert log is artifacts.logger("test-log") and len(log.handlers) == 3


def test_saved_models_come_back(spark, tmp_path):
    m = T.model(spark)
    artifacts.save_model(m, f"{tmp_path}/m", counts={"latin": 3})
    back = artifacts.load_model(spark, f"{tmp_path}/m")
    df = texts_of(spark, *ODD)
    ids = lambda x: sorted((r.i, r.x) for r in df.select("i", x.encode(F.col("text")).alias("x")).collect())
    assert ids(back) == ids(m) and back.rules == m.rules and back.old_to_new == m.old_to_new
    assert len(artifacts.copy_model(f"{tmp_path}/m", f"{tmp_path}/n", "p-")) == 9
    same = artifacts.identity_model(spark, T.OLD)
    assert same.stats()["common"] == len(T.OLD)
    built = artifacts.ModelBuilder(spark).old(T.OLD).new(T.NEW).mapping(T.NEW_TO_OLD).target("arabic").normalization(S.ARABIC_RULES).options(specials=T.SPECIALS).build()
    assert ids(built) == ids(m)
    with pytest.raises(ValueError, match="new_to_old"):
        artifacts.ModelBuilder(spark).old(T.OLD).new(T.NEW).build()
    m.register(spark)
    assert spark.sql("select dual_decode(array(4, 5)) x").first().x == T.OLD.pieces[4].decode() + T.OLD.pieces[5].decode()


def test_commands_build_a_model(spark, tmp_path):
    letters = "привет мир слово"
    merges = [(c.encode()[:1], c.encode()[1:]) for c in dict.fromkeys(letters.replace(" ", ""))]
    old = ByteVocabulary(["<s>"], merges)
    (tmp_path / "old.json").write_text(json.dumps({"specials": old.specials, "merges": [[a.hex(), b.hex()] for a, b in old.merges]}))
    spark.createDataFrame([("كتاب كتاب مجلة",), ("مجلة كتاب",), ("слово",), (None,)], "text string").write.parquet(f"{tmp_path}/corpus")
    assert commands.main(["classify-tokens", "--old-vocabulary", str(tmp_path / "old.json"), "--output", str(tmp_path / "counts.json")]) == 0
    assert json.loads((tmp_path / "counts.json").read_text())["cyrillic"] == len(merges)
    args = ["create-tokenizer", "--old-vocabulary", str(tmp_path / "old.json"), "--output_dir", str(tmp_path / "out"), "--training_data_dir", str(tmp_path / "corpus"), "--vocab_size", "6", "--target_scripts", "arabic", "--preserved_scripts", "latin,greek", "--special_tokens", "<s>", "--first_reusable_id", "257"]
    assert commands.main(args) == 0
    assert spark.read.parquet(f"{tmp_path}/out/cleaned").count() == 3 and spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1
    m = artifacts.load_model(spark, f"{tmp_path}/out/model")
    assert len(m.new.merges) == 6 and all(old.pieces[m.new_to_old[i]].decode() in letters for i in range(257, len(m.new)))
    r = texts_of(spark, "كتاب مجلة book").select(F.size(m.encode(F.col("text"))).alias("n"), m.decode(m.encode(F.col("text"))).alias("d")).first()
    assert r.d == "كتاب مجلة book" and r.n < len("كتاب مجلة book".encode())


def test_fertility_of_words(spark):
    w = spark.createDataFrame([("the", 2)], "word string, n long")
    assert bpe.encode_words(w, [("t", "h"), ("th", "e")]).first().symbols == ["the"]


def test_many_words_meet_the_plain_encoding():
    rng = random.Random(9)
    v = ByteVocabulary.of_pairs(["<s>"], plain_train([([ByteVocabulary(["<s>"]).byte_id[b] for b in w.encode()], n) for w, n in random_words(rng, 80)], 257, 60))
    words = ["", "aaaaa", "a" * 63, "a" * 200, *(w for w, _ in random_words(rng, 300)), "", "ab" * 40]
    ids, size = v.encode_many(words)
    ends = size.cumsum().tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [plain_encode(v, w) for w in words]
    assert [len(x) for x in v.encode_many([])] == [0, 0] and ByteVocabulary().encode_many(["ab"])[1].tolist() == [2]


@pytest.mark.parametrize("specials, first", [(["the", "<|sep|>"], False), ([], False), (["the"], True)])
def test_workers_cut_as_columns_do(spark, specials, first):
    rng = random.Random(10)
    odd = "aZ é1²٣ \t\n\x1c\x85\u00a0\u2003\u3000'st.,_—ʰाجف中\U0001d49c\U0001f600\U00020000\U0001ee00" + chr(0x677) + chr(0xFEFB) + chr(0x6CC) + chr(0x1C89) + chr(0x2EBF0)
    rows = ["".join(rng.choice([*odd, "the", "<|sep|>", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    rules = S.ARABIC_RULES | {ord("Z"): [], ord("_"): [0x1D49C]}
    m = DualModel(spark, T.OLD, T.NEW, T.NEW_TO_OLD, "arabic", rules, specials, normalize_first=first)
    for r in texts_of(spark, *rows).select("text", m.words(F.col("text")).alias("w")).collect():
        cut = None if r.text is None else [route + w for route, words in m.codec.cutter.cut(r.text) for w in words]
        assert cut == r.w, r.text


def test_workers_hold_pieces_and_a_bounded_cache(spark, monkeypatch):
    import pyarrow as pa

    from scriptloom.operators import dual

    rng = random.Random(11)
    texts = pa.array([" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(100)) for _ in range(3000)] + [None, "", "x" * (3 << 20)])
    some = list(dual._pieces(texts))
    assert pa.concat_arrays(some).equals(texts) and all(x.nbytes < 2.5 * dual.PIECE_BYTES for x in some[:-1]) and len(some) >= 3
    monkeypatch.setattr(dual, "CACHE_BYTES", 1 << 20)
    codec = T.model(spark).codec
    held = []
    for x in dual._pieces(texts.slice(0, 3000)):
        ids, _ = codec.encode(x)
        held.append(codec.held)
        assert all(len(i) <= 2 * dual.PIECE_IDS for i in dual._pieces(ids))
        assert codec.decode(ids, False, True).equals(x)
    assert len(held) > 2 and held[-1] < 1.5 * held[0]


def test_documents_without_words_have_no_row(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(0, "", "en", "s", 0), (5, "the cat", "en", "s", 7), (7, None, "fr", "s", 0), (9, "of ab بت", "fr", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("encode_dual", "roundtrip_ok", "roundtrip_summary", "encoding_struct"):
        df = T.query.__globals__["QUERIES"][name](spark, str(tmp_path))
        cur = c.execute(T.query.__globals__["ORACLES"][name])
        at = [[x[0] for x in cur.description].index(k) for k in df.columns]
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in cur.fetchall()), name


@pytest.mark.parametrize("one_task", [2_000_000, 0])
def test_training_of_characters_meets_the_recount(spark, one_task):
    rng = random.Random(12)
    rows = [*random_words(rng, 80), ("aaaaaaa", 3), ("éééé", 2), ("ababab" * 3, 1)]
    df = spark.createDataFrame([*rows, (None, 4), ("", 3), ("x", 9)], "word string, n long")
    got = [tuple(r) for r in bpe.train(df, 60, one_task=one_task).orderBy("rank").collect()]
    seqs, want = [(list(w), n) for w, n in rows], []
    for rank in range(60):
        total = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                total[p] = total.get(p, 0) + n
        if not total:
            break
        best = min(total, key=lambda p: (-total[p], p))
        want.append((rank, *best, total[best]))
        for s, _ in seqs:
            i = 0
            while i + 1 < len(s):
                if tuple(s[i : i + 2]) == best:
                    s[i : i + 2] = ["".join(best)]
                i += 1
    assert got == want


def test_training_takes_time_by_the_places_of_a_merge():
    import time

    import numpy as np

    from scriptloom.operators import merges

    rng = np.random.default_rng(13)
    size = rng.integers(4, 20, 200_000)
    symbols = (rng.random(int(size.sum())) ** 3 * 256).astype(np.int32)
    began = time.thread_time()
    found = merges.learn(merges.Words(symbols, size, rng.integers(1, 9, len(size)), 256), 1000, merges.by_ids)
    assert len(found) == 1000 and time.thread_time() - began < 60
    left, right, n = found[0]
    inside = np.ones(len(symbols), bool)
    inside[np.cumsum(size) - 1] = False
    assert 0 <= left < 256 and 0 <= right < 256 and n > 0 and inside.sum() == len(symbols) - len(size)


def test_sizes_of_documents_with_a_small_cache(spark, monkeypatch):
    rng = random.Random(14)
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc"), (" ", "a"), ("1", "1"), ("abc", "abc"), ("s", "t"), ("a", "b")]
    rows = [(i % 7, "".join(rng.choice("abc'st 1²\n\u00a0\U0001d49c") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(8, None), (9, "")]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 400)
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    plain = df.select("k", F.explode(S.pretokens(F.col("text"))).alias("w")).collect()
    ranks = {m: i for i, m in enumerate(merges)}
    want = {}
    for r in plain:
        n, t = want.get(r.k, (0, 0))
        want[r.k] = (n + 1, t + len(bpe.apply_merges(r.w, ranks)))
    sizes = bpe.encoded_sizes(df, merges, key="k")
    assert {r.k: (r.words, r.tokens) for r in sizes.collect()} == want
    assert "regexp_extract_all" not in sizes._jdf.queryExecution().executedPlan().toString()  # lists of words don't go through Spark's batches
