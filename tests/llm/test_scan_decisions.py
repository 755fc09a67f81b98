"""What the editor of scanned words decides."""

import itertools

from pyspark.sql import functions as F

from dsforge.llm import scan_repair
from dsforge.llm.scan_repair import Editor

HEADS = [2 * (c + v) for c, v in itertools.product("bdgkpstvzlfh", "aeu")]  # two letters or more apart


def meant(editor: Editor, word: str):
    got = editor.decide(word, 1, editor.lexicon)
    return got and got[3]


def test_keep_beats_edits_between_true_words():
    lexicon = {f"{h}m{t}": 500 for h in HEADS[:30] for t in ("et", "ush")}
    lexicon |= {f"{h}{v}gel": 400 for h in HEADS[:24] for v in "io"} | {f"{h}ogel": 400 for h in HEADS[24:]}
    misread = [(f"{h}rn{t}", 1) for h in HEADS[:30] for t in ("et", "ush")]
    true = [(f"{h}igel", 1) for h in HEADS[24:]]  # rare words, an edit away from frequent ones
    editor = Editor(lexicon).fit(misread + true)
    assert "o" in editor.ops["i"]
    assert [meant(editor, w) for w, _ in misread] == [w.replace("rn", "m") for w, _ in misread]
    assert [meant(editor, w) for w, _ in true] == [None] * len(true)
    editor.weights, editor.known = {}, {}
    assert [meant(editor, w) for w, _ in misread] == [None] * len(misread)  # nothing but the perceptron decides


def test_lost_and_added_letters_and_two_faults():
    lexicon = {f"{h}mond": 500 for h in HEADS}
    lost, added = [(f"{h}mnd", 1) for h in HEADS[:12]], [(f"{h}moond", 1) for h in HEADS[12:24]]
    misread = [(f"{h}rnond", 1) for h in HEADS[24:]]
    editor = Editor(lexicon).fit(lost + added + misread)
    assert editor.ops[""] == ["o"] and editor.ops["o"] == [""]
    for words, seen in ((lost, "mnd"), (added, "moond"), (misread, "rnond")):
        assert [meant(editor, w) for w, _ in words] == [w.replace(seen, "mond") for w, _ in words]
    assert meant(editor, "babarnnd") == "babamond"  # a misread and a lost letter
    assert meant(editor, "fafbond") is None


def trained():
    lexicon = {f"{h}m{t}": 500 for h in HEADS[:30] for t in ("et", "ush")}
    return Editor(lexicon).fit([(f"{h}rn{t}", 1) for h in HEADS[:30] for t in ("et", "ush")])


def test_no_word_is_left_out_of_a_large_lexicon(spark):
    """More words than one block holds, all of the same count: each can be the target of a repair, none is repaired itself."""
    n = scan_repair.MAX_WORDS + 20_000
    word = F.concat(F.lit("zam"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("x"))
    counts = spark.range(n).select(word.alias("word"), F.lit(40).cast("long").alias("n"))
    misread = counts.where("hash(word) % 50 = 0").select(F.replace("word", F.lit("zam"), F.lit("zarn")).alias("word"), F.lit(1).cast("long").alias("n"))
    got = scan_repair.decide_parts(misread.unionAll(counts), counts, trained())
    assert got.count() == misread.count() == got.where("fixed = replace(core, 'rn', 'm')").count()


def test_blocks_of_the_lexicon_give_the_same(spark, monkeypatch):
    editor = trained()
    words = [(w, 1) for h in HEADS[:20] for w in (f"{h}rnet", f"{h}rnrnush", f"{h}rnat", h)]
    counts = spark.createDataFrame([*words, *editor.lexicon.items(), *((f"{h}mmush", 90) for h in HEADS[:9])], "word string, n long")
    whole = sorted(map(tuple, scan_repair.decide_parts(counts, counts, editor).collect()))
    monkeypatch.setattr(scan_repair, "MAX_WORDS", 7)
    assert len(whole) == 29 and sorted(map(tuple, scan_repair.decide_parts(counts, counts, editor).collect())) == whole


def test_words_of_several_parts(spark):
    parts = spark.createDataFrame([("rnan", "man"), ("tbe", "the")], "core string, fixed string")
    cores = spark.createDataFrame([("rnan's-tbe/x",), ("a-b",), ("tbe.tbe",)], "core string")
    assert sorted(map(tuple, scan_repair._assembled(cores, parts).collect())) == [("rnan's-tbe/x", "man's-the/x"), ("tbe.tbe", "the.the")]
