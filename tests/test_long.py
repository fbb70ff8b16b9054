"""Long sentences with thousands of mentions, and rows that a query must not move or hold: each step grows with its input."""

import random
import threading

from pyspark.sql import functions as F

from tagforge.functions import text as T
from tagforge.operators import bio, cascade, dynamic, evaluation, prompts, spans
from tagforge.operators.numbering import numbered
from tagforge.operators.taxonomy import Taxonomy
from tagforge.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
MENTIONS = "array<struct<entity:string,category:string>>"


def soon(spark, df, seconds=25):
    """The rows of df; its jobs are cancelled, and the test fails, after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long_words(n=8000, kinds=40):
    r = random.Random(1)
    return [r.choice(["entity", "museum", "station"]) + chr(97 + r.randrange(kinds) % 26) * (1 + r.randrange(kinds) // 26) for _ in range(n)]


def plain_tags(tokens, mentions):
    tags = ["O"] * len(tokens)
    for e, c in mentions:
        part = e.split()
        at = next((i for i in range(len(tokens)) if part and tokens[i : i + len(part)] == part), -1)
        if at >= 0:
            tags[at : at + len(part)] = [("B-" if k == 0 else "I-") + c for k in range(len(part))]
    return tags


def test_encode_of_long_sentences(spark):
    words = long_words()
    cases = [(" of ".join(words), [(w, f"c{i % 90}") for i, w in enumerate(words)])]
    r = random.Random(3)
    for _ in range(40):
        tokens = [r.choice("abc") for _ in range(12)]
        cases.append((" ".join(tokens), [(" ".join(r.choice("abc") for _ in range(r.randint(0, 3))), f"c{k}") for k in range(6)]))
    d = spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(cases)], f"ord int, sentence string, mentions {MENTIONS}")
    got = {x.ord: x for x in soon(spark, bio.encode(d))}
    for i, (s, m) in enumerate(cases):
        assert got[i].tokens == s.split() and got[i].tags == plain_tags(s.split(), m)


def test_numbering_moves_no_row_twice(spark):
    d = spark.createDataFrame([(i % 17, i) for i in range(500)], "a int, b int").repartition(5)
    n = numbered(d, "a", "b")
    assert "Window" not in plan(n) and "Exchange hashpartitioning" not in plan(n)
    assert [(x.a, x.b) for x in n.orderBy("n").collect()] == sorted((i % 17, i) for i in range(500))


def test_white_space_at_the_ends_and_between(spark):
    d = spark.range(1, 0x3100).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    d = d.select("c", F.concat("c", F.lit("a"), "c").alias("x"))
    assert d.where("length(c) = 1").count() == 0x3100 - 1
    assert d.where(T.strip(F.col("x")) != F.regexp_replace("x", rf"^{T.WS}+|{T.WS}+$", "")).count() == 0
    r = random.Random(5)
    texts = ["".join(r.choice("ab-\n \t\x85 \x1c") for _ in range(30)) for _ in range(300)]
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", rf"-\n{T.WS}*", ""), "\n", " "), rf"{T.WS}+", " "), "^ +| +$", "")
    assert spark.createDataFrame([(t,) for t in texts], "t string").where(T.clean(F.col("t")) != old).count() == 0


def test_options_need_no_sentence(spark):
    """A long sentence of many mentions: rewrites read the options alone, unless the sentence has a list of its own."""
    words = long_words(3000)
    d = spark.createDataFrame([(0, " of ".join(words), [(w, "city") for w in words]), (1, "See list: museums, or so: it is", [("museums", "film")])], f"ord int, sentence string, mentions {MENTIONS}")
    short, full = (prompts.stage2(d, Taxonomy.of(), sentences=x).select("row_id", "prompt", "answer") for x in (False, True))
    parts = lambda r: [c.alias(k) for k, c in {"a": T.list_options(F.col("prompt")), "b": T.tail_options(F.col("prompt")), "c": T.listed(F.col("prompt"))}.items()]
    got = soon(spark, short.select("row_id", F.length("prompt").alias("n"), *parts(short)))
    few = full.where("row_id % 97 < 3 or row_id >= 3 * (1L << 32)")
    want = {r.row_id: r for r in few.select("row_id", *parts(few)).collect()}
    assert len(got) == 9003 and sum(r.n for r in got) < 9003 * 400 and len(want) > 100
    assert all((r.a, r.b, r.c) == (want[r.row_id].a, want[r.row_id].b, want[r.row_id].c) for r in got if r.row_id in want)
    assert {tuple(r.a) for r in got if r.row_id >> 32 >= 3} == {("##museums##", "or so: it is\" belongs to which entity in the ")}


def test_lists_in_one_string(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b c", ",", ", ", " ", "?", "\t", "\u00a0", ":"]) for _ in range(8)) for _ in range(500)]
    d = spark.createDataFrame([(t,) for t in [*texts, None, "x: a, b c, d?"]], "t string")
    assert d.where(~T.tail_joined(F.col("t")).eqNullSafe(F.array_join(T.tail_options(F.col("t")), "|"))).count() == 0


def test_rewrites_look_pairs_up(spark, monkeypatch):
    """Each stage gives the same with lists worked out once for a pair and for each row."""
    t = Taxonomy.of()
    rows = [(i, f"q: {', '.join(t.options(k, p[k - 1]))}?", p[k - 1]) for i, n in enumerate(sorted(t.leaf_parent()) * 2) for p in [t.path(n)] for k in [i % 3 + 1]]
    d = spark.createDataFrame([*rows, (9000, None, "city"), (9001, "no list", None)], "row_id long, prompt string, answer string")
    run = lambda f: sorted(map(str, f(d, t).collect()))
    stages = (dynamic.swap_synonyms, dynamic.reduce_options, dynamic.special_answers)
    once = [run(f) for f in stages]
    monkeypatch.setattr(dynamic, "PAIRS", 0)
    assert [run(f) for f in stages] == once and all(len(x) == len(rows) + 2 for x in once)


def test_decoding_of_arrays(spark):
    r = random.Random(8)
    tags = ["O", "", "B-X", "I-X", "B-Y", "I-Y", "B-", "I-", "?", None]
    rows = [(i, [r.choice("abc") for _ in range(n)], [r.choice(tags) for _ in range(n)]) for i in range(120) for n in [r.randrange(12)]]
    d = spark.createDataFrame(rows, "id int, tokens array<string>, tags array<string>")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(bio.decode_arrays(d, "id")) == key(bio.decode(bio.token_rows(d, "id"), "id")) and "Exchange" not in plan(bio.decode_arrays(d, "id"))
    files = [(i, [r.choice(["", " ", "a x O", "b  LOC", "c PER", "d\tPER", "lone"]) for _ in range(r.randrange(9))]) for i in range(120)]
    f = spark.createDataFrame(files, "file int, lines array<string>")
    lines = f.select("file", F.posexplode("lines").alias("line_no", "value"))
    for keep in (True, False):
        a, b = (x.select("file", "text", "entities") for x in (bio.decode_plain_arrays(f, keep), bio.decode_plain(lines, keep)))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and "Exchange" not in plan(a)


def test_records_are_not_grouped(spark):
    for name in ("base_build", "synthetic_filter", "bio_decode", "io_decode"):
        assert "hashpartitioning" not in plan(QUERIES[name](spark, SF))


def test_marking_and_folding_of_long_sentences(spark):
    words = long_words(6000, 26)
    d = spark.createDataFrame([(0, " of ".join(words), [(w, "city") for w in words])], f"ord int, sentence string, mentions {MENTIONS}")
    got = soon(spark, prompts.stage1(d))[0]
    assert got.answer.count("##") == 12000 and got.answer.replace("##", "") == got.prompt
    rows = spark.createDataFrame([(got.prompt, 1, got.answer)] * 3, "query string, ord int, response string")
    assert len(soon(spark, spans.merged_responses(rows))[0].spans) == len(set(words))


def test_folding_of_equal_responses(spark):
    r = random.Random(9)
    rows = []
    for q in range(40):
        query = f"{q} " + "".join(r.choice("abc") for _ in range(12))
        cut = lambda query=query: "x ".join(f"##{query[a : a + r.randint(0, 4)]}##" for a in r.choices(range(len(query)), k=4))
        kinds = [(r.randrange(2), cut()) for _ in range(3)]
        rows += [(query, *r.choice(kinds)) for _ in range(7)]
    d = spark.createDataFrame(rows, "query string, ord int, response string")
    old = d.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "response"))).alias("r"))
    old = old.select("query", spans.merge(F.flatten(F.transform("r", lambda x: spans.extract(F.col("query"), x["response"])))).alias("spans"))
    assert sorted(map(str, spans.merged_responses(d).collect())) == sorted(map(str, old.collect()))


def test_scores_of_arrays(spark):
    r = random.Random(10)
    label = lambda: (r.choice(["Roma", "roma", "a", "a1"]), r.choice(["City", "x", "1x"]))
    rows = [(i, [label() for _ in range(r.randrange(4))], [label() for _ in range(r.randrange(4))]) for i in range(60)]
    pairs = "array<struct<entity:string,category:string>>"
    d = spark.createDataFrame(rows, f"id int, truth {pairs}, predicted {pairs}")
    t, p = (d.select("id", F.explode(c).alias("x")).select("id", "x.*") for c in ("truth", "predicted"))
    for keys in (["entity"], ["entity", "category"]):
        for strict in (False, True):
            got = evaluation.score_arrays(d, keys, strict)
            assert got.collect() == evaluation.score(t, p, keys, strict=strict).collect()
    assert plan(evaluation.score_arrays(d, keys)).count("hashpartitioning") == 1


def test_counts_are_taken_in_their_rows(spark):
    assert "Exchange" not in plan(QUERIES["count_compare_by_index"](spark, SF)) and "Join" not in plan(QUERIES["count_compare_by_text"](spark, SF))


def test_replies_are_joined_once(spark):
    e = spark.createDataFrame([(1, 0, "x", "x y"), (1, 1, "y", "x y"), (2, 0, "a", "a b"), (2, 1, "b", "a b")], "id int, pos int, entity string, sentence string")
    wide = [("1|0", ["PERSON", "real person", "Artist"]), ("1|1", ["unknown", None, None]), ("2|0", ["person", "real person", "nonsense"])]
    w = spark.createDataFrame(wide, "key string, replies array<string>")
    long = w.select("key", F.posexplode("replies").alias("k", "reply")).select("key", (F.col("k") + 1).alias("level"), "reply")
    got, want = (cascade.classify(e, Taxonomy.of(), c) for c in (cascade.Wide(w), cascade.by_table(long)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    p = plan(QUERIES["cascade_predictions_whole"](spark, SF))
    assert p.count("SortMergeJoin") <= 1 and "sentence" not in p.split("Exchange hashpartitioning")[1].split("\n")[0]


def test_forms_are_counted_in_their_rows(spark, tmp_path):
    spark.createDataFrame([(1, "Zebra museum garden museum MUSEUM gardens garden museum. Too short."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = QUERIES["synonym_forms_whole"](spark, str(tmp_path))
    assert "hashpartitioning" not in plan(q)
    assert sorted(tuple(r) for r in q.collect()) == [(0, "garden", 2), (0, "gardens", 1), (0, "museum", 4)]
