"""Golden vectors and small cases of the corpus operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tagforge.functions import rng
from tagforge.functions import text as T
from tagforge.operators import bio, cascade, dynamic, evaluation, metrics, prompts, quality, sampling, spans
from tagforge.operators.numbering import numbered
from tagforge.operators.taxonomy import Taxonomy, synonym_map, synonyms
from tagforge.sources import corpus
from tagforge.streaming.counts import answer_counts, windowed_counts

S = "L'Università di Bologna ha sede a Bologna."
MENTIONS = "array<struct<entity:string,category:string>>"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], [*names]).select(column.alias("v")).first().v


def base(spark, *rows):
    return spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(rows)], f"ord int, sentence string, mentions {MENTIONS}")


@pytest.fixture(scope="module")
def bologna(spark):
    return base(spark, (S, [("Università di Bologna", "school"), ("Bologna", "city")]))


def test_taxonomy():
    t = Taxonomy.of()
    assert (len(t.first), len(t.second), sum(map(len, t.second.values())), sum(map(len, t.third.values())), len(t.all_names())) == (8, 8, 31, 155, 186)
    p, b, leaf = t.parent(), t.branch(), t.leaf_parent()
    assert (p["biological"], p["address"], p["miscellaneous"]) == ("science entity", "address", "miscellaneous")
    assert (b["biological"], b["address"], b.get("person"), leaf["biological"]) == ("L1::science entity", "L2::address", None, "weapon")
    assert t.path("school") == ("facility", "public facility", "school") and t.path("biological") == ("product", "weapon", "biological") and t.path("xyz") == ("miscellaneous",) * 3
    assert t.children()["miscellaneous"][0] == "educational degree" and t.siblings("address") == list(t.first)
    assert t.options(3, "weapon") == [] and t.options(2, "person") == ["real person", "fictional figure"]


def test_nested_taxonomy_and_lists():
    t = Taxonomy.nested({"A": {"B": ["C", "D"]}})
    assert t.path("C") == ("A", "B", "C")
    assert Taxonomy.of("a,b", {"a": "c, d,"}, {"c": ["e"]}, ",").second == {"a": ["c", "d"]}


def test_synonyms(spark):
    lines = spark.createDataFrame([(0, "A b---x"), (1, "bad"), (2, "a b --- y"), (3, "p---q---r")], "line_no int, value string")
    assert [tuple(r) for r in synonyms(lines).collect()] == [("a b", "y")]
    assert len(synonym_map()) == 186 and synonym_map(separator="=") == {}


def test_text(spark):
    assert value(spark, T.tokens(F.col("s")), s="L'ab_1, è²x‿y") == ["L", "'", "ab_1", ",", "è²x", "‿", "y"]
    assert value(spark, T.fold(F.col("s")), s="Àé ﬁ漢") == "ae fi"
    assert value(spark, T.apostrophes(F.col("s")), s="l’é `x`") == "l'é 'x'"
    assert value(spark, T.characters(F.col("s")), s="a 漢😀") == ["a", " ", "漢", "😀"]
    assert value(spark, T.marked_entity(F.col("s")), s="a ##b## ##c##") == "b"
    msg = 'The ##x## in the sentence: "a: b" belongs to which entity in the list: p, q r?'
    assert value(spark, T.tail_options(F.col("s")), s=msg) == ["p", "q r"] == value(spark, T.list_options(F.col("s")), s=msg)
    assert value(spark, T.with_options(F.col("s"), F.array(F.lit("z"), F.lit("y"))), s=msg).endswith("list: z, y?")
    assert value(spark, T.with_options(F.col("s"), F.array(F.lit("z"))), s="none") == " z?"
    assert value(spark, T.synonym_form(F.col("s")), s="  A  \n B. ") == "a b"
    assert value(spark, T.clean(F.col("s")), s=" a-\n  b\nc  d ") == "ab c d"
    assert value(spark, T.sentences(F.col("s")), s="This is a long enough one. short. And here is another one! x") == ["This is a long enough one. short.", "And here is another one! x"]
    assert value(spark, T.listed(F.col("s")), s=msg + " If none") == "p, q r"
    assert value(spark, T.unfenced(F.col("s")), s="```json\n[1]\n```") == "[1]" and value(spark, T.unfenced(F.col("s")), s="[2]") == "[2]"
    assert value(spark, T.mark_first(F.col("s"), F.lit("Bologna")), s=S) == "L'Università di ##Bologna## ha sede a Bologna."
    assert value(spark, T.mark_first(F.col("s"), F.lit("a.b")), s="axb a.b") == "axb ##a.b##"


def test_hash_chance(spark):
    assert value(spark, rng.uniform(42, F.lit(7), "a"), s="") == 0.44240748789161444
    n = spark.range(1000).select(rng.randint(1, F.col("id"), "k", 3, 5).alias("n")).distinct()
    assert sorted(r.n for r in n.collect()) == [3, 4, 5]


def test_bio(spark, bologna):
    r = one(bio.encode(bologna))
    assert r.tags == "O O B-school I-school B-city O O O O O".split()
    rows = bio.token_rows(bio.encode(bologna), "ord")
    assert [(x.entity, x.category) for x in bio.decode(rows, "ord").orderBy("start").collect()] == [("Università di", "school"), ("Bologna", "city")]
    zh = one(bio.encode(base(spark, ("北京大学", [("大学", "school"), ("", "city")])), T.characters))
    assert zh.tags == ["O", "O", "B-school", "I-school"]
    assert one(bio.to_lines(bio.encode(base(spark, ("a b", [("b", "real person")]))))).value == "a O\nb B-real_person\n"


def test_bio_decode_of_noise(spark):
    rows = [(1, i, t, g) for i, (t, g) in enumerate(zip("abcdef", ["B-X", "I-X", "I-Y", "?", "I-Y", "O"], strict=True))] + [(2, 0, "z", "B-"), (3, 0, "q", "")]
    got = bio.decode(spark.createDataFrame(rows, "id int, pos int, token string, tag string"), "id").orderBy("id", "start").collect()
    assert [(r.entity, r.category) for r in got] == [("a b", "X"), ("c e", "Y")]


def test_convert(spark):
    rows = [(1, 0, "Anna", "B-Artist"), (1, 1, "x", "O"), (2, 0, "y", "O"), (3, 0, "n", "B-NOVEL"), (4, 0, "m", "B-ORG"), (4, 1, "k", "I-ORG")]
    rec, lost, counts = bio.convert(spark.createDataFrame(rows, "sentence_id int, pos int, token string, tag string"), Taxonomy.of().leaf_table(spark))
    assert {(r.text, r.entities[0].text, r.entities[0].category) for r in rec.collect()} == {("Anna x", "Anna", "artist"), ("m k", "m k", "other non-commercial organization")}
    assert [tuple(r) for r in lost.collect()] == [("NOVEL", 1)] and tuple(one(counts)) == (2, 2)
    assert value(spark, bio.tag_names(F.col("t"), ["O", "B-A"]), t=[1, 0]) == ["B-A", "O"]


def test_plain_tags(spark):
    text = ["Napoleone x PER", "III x PER", "a x O", "lone", "Roma x LOC", "", "", "fine x O", "Pisa x LOC"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "file string, line_no int, value string")
    got = bio.decode_plain(lines).orderBy("idx").collect()
    assert [(r.text, r.entities) for r in got] == [("Napoleone III a Roma", ["Napoleone III", "Roma"]), ("fine Pisa", ["Pisa"])]
    assert bio.decode_plain(lines, keep_unterminated=False).count() == 1


def plain_mark(sentence, entities):
    taken, spans_ = [], []
    for e in sorted(set(entities), key=lambda e: (-len(e), e)):
        at = sentence.find(e) if e else -1
        while at >= 0:
            if all(at + len(e) <= a or at >= b for a, b in taken):
                taken.append((at, at + len(e)))
            at = sentence.find(e, at + 1)
    out, last = "", 0
    for a, b in sorted(taken):
        out, last = out + sentence[last:a] + "##" + sentence[a:b] + "##", b
    return out + sentence[last:]


def test_marking(spark, bologna):
    assert one(prompts.stage1(bologna)).answer == "L'##Università di Bologna## ha sede a ##Bologna##."
    nested = base(spark, ("the restaurant Guangzhou in Guangzhou", [("Guangzhou", "x"), ("restaurant Guangzhou", "y")]))
    assert one(prompts.stage1(nested)).answer == "the ##restaurant Guangzhou## in ##Guangzhou##"
    r = random.Random(2)
    cases = [("".join(r.choice("ab ") for _ in range(20)), ["".join(r.choice("ab") for _ in range(r.randint(0, 3))) for _ in range(3)]) for _ in range(60)]
    got = prompts.stage1(base(spark, *[(s, [(e, "x") for e in es]) for s, es in cases])).orderBy("ord").collect()
    assert [g.answer for g in got] == [plain_mark(s, es) for s, es in cases]


def test_stage2(spark, bologna):
    rows = prompts.stage2(bologna, Taxonomy.of()).orderBy("row_id").collect()
    assert [r.answer for r in rows] == ["facility", "public facility", "school", "location", "geo-political entity", "city"]
    assert rows[5].prompt == 'The ##Bologna## in the sentence: "L\'Università di Bologna ha sede a ##Bologna##." belongs to which entity in the list: continent, country, state or province, city, district, region, other gpe?'
    assert len({r.row_id // 3 for r in rows}) == 2 and rows[0].conversations[1].value == "facility"
    behind = prompts.stage2(base(spark, ("x y", [("y", "city"), ("x", "city")])), Taxonomy.of()).where("pos = 1 and level = 1")
    assert '"x y"' in one(behind).prompt
    upper = prompts.stage2(base(spark, ("x", [("x", "weapon")])), Taxonomy.of()).orderBy("level").collect()
    assert [r.answer for r in upper] == ["product", "weapon", "weapon"] and upper[2].options == []


def test_base_sentences(spark):
    rec = [("l’arte a Roma", [("l'arte", "film"), ("Roma", " city ")]), ("x", [("y", "city")]), ("x", [("x", "nope"), ("q", "city")]), ("x", []), ("x", None), ("x", [("", "city")])]
    d = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rec)], "ord int, text string, entities array<struct<text:string,category:string>>")
    got = prompts.base_sentences(d, Taxonomy.of().leaf_table(spark)).orderBy("ord").collect()
    assert [r.reason for r in got] == [None, "not_in_text", "invalid_category", "no_entity", "no_entity", None]
    assert got[0].sentence == "l'arte a Roma" and got[0].mentions[1].category == "city" and got[1].sentence_id == "sentence2"


def test_row_shapes(spark):
    raw = ['{"query":"q","response":"r"}', '{"messages":[{"role":"user","content":"a"},{"role":"user","content":"b"},{"role":"assistant","content":"c"}]}', '{"conversations":[{"from":"user","value":"d"},{"from":"assistant","value":"e"}]}', '{"query":"only"}']
    d = spark.createDataFrame([(x,) for x in raw], "v string").select(F.from_json("v", corpus.SHAPES).alias("r")).select("r.*")
    assert {(r["query"], r.response) for r in prompts.normalised_rows(d).collect()} == {("q", "r"), ("b", "c"), ("d", "e")}


def plain_merge(items):
    held = []
    for t, a, b in items:
        i = next((i for i, (_, x, y) in enumerate(held) if not (y <= a or x >= b)), None)
        if i is None:
            held.append((t, a, b))
        elif b - a > held[i][2] - held[i][1]:
            held[i] = (t, a, b)
    return held


def test_spans(spark):
    r = random.Random(4)
    cases = [[("ab", 0, 2), ("abc", 0, 3), ("z", 9, 10)]] + [[(str(i), a, a + r.randint(1, 6)) for i, a in enumerate(r.choices(range(20), k=6))] for _ in range(40)]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s {spans.SPANS}")
    assert [[tuple(x) for x in row.m] for row in d.select("i", spans.merge(F.col("s")).alias("m")).orderBy("i").collect()] == [plain_merge(c) for c in cases]
    got = value(spark, spans.extract(F.lit("la Roma di Roma"), F.col("r")), r="la ##Roma## di ##x## ##di##")
    assert [tuple(x) for x in got] == [("Roma", 3, 7), ("di", 8, 10)]


ANSWERS = ["person", "real person", "politician", "person", "real person", "artist", "location", "geo-political entity", "city", "location", "geo-political entity", "city"]


def test_metrics(spark):
    d = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    m = metrics.evaluate(d, Taxonomy.of())
    r = one(m)
    assert [round(r[n], 6) for n in metrics.NAMES] == [0.060606, 0.980150, 0.119048, 0.263523]
    assert round(one(m.select(metrics.health(m).alias("h"))).h, 6) == 0.583937
    same = metrics.evaluate(spark.createDataFrame([("city",), ("city",)], "answer string"), Taxonomy.of())
    assert [one(same)[n] for n in metrics.NAMES] == [1.0, 0.0, 0.0, 0.0]
    none = metrics.evaluate(d.where("false"), Taxonomy.of())
    assert [one(none)[n] for n in metrics.NAMES] == [0.0] * 4
    conv = spark.createDataFrame([([("user", "q"), ("assistant", "city")],), ([("user", "q")],)], "conversations array<struct<`from`:string,value:string>>")
    assert [x.answer for x in metrics.answers(conv).collect()] == ["city"]


def test_embedding_cohesion(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i % 3, [float(x) for x in r.normal(size=5)]) for i in range(20)] + [(9, [1.0] * 5), (0, [0.0] * 5)]
    per = []
    for k in range(3):
        u = np.array([v for i, v in rows if i == k])
        u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
        c = u @ u.T
        per.append(c[np.triu_indices(len(u), 1)].mean())
    assert one(metrics.embedding_cohesion(spark.createDataFrame(rows, "label int, embedding array<double>"))).cohesion == pytest.approx(np.mean(per))


def options(spark, *rows):
    q = lambda o: f'The ##e## in the sentence: "s ##e##" belongs to which entity in the list: {", ".join(o)}?'
    return spark.createDataFrame([(i, q(o), a) for i, (o, a) in enumerate(rows)], "row_id long, prompt string, answer string")


def test_merge_stage(spark, monkeypatch):
    monkeypatch.setattr(rng, "uniform", lambda *_: F.lit(0.0))
    t = Taxonomy.of()
    d = options(spark, (t.first, "person"), (["real person", "fictional figure"], "real person"), (["politician", "artist"], "artist"), (t.first, "location"), (["address"], "address"), (["x"], "x"), (t.first, "art"))
    got = dynamic.merge(d, t).orderBy("row_id").collect()
    assert [r.row_id for r in got] == [0, 2, 3, 5, 6] and got[0].answer == "real person"
    lists = [r.prompt.rsplit(": ", 1)[1] for r in got]
    assert lists[0] == "art, facility, fictional figure, group, location, miscellaneous, product, real person, science entity?"
    assert "location" in lists[2] and "address" in lists[2]


def test_special_stage(spark, monkeypatch):
    monkeypatch.setattr(rng, "uniform", lambda *_: F.lit(0.0))
    d = options(spark, (["geographical entity", "geo-political entity", "address"], "address"), (["other art", "film", "miscellaneous", "play"], "film"), (["a", "b"], "a"))
    got = dynamic.special_answers(d, Taxonomy.of()).orderBy("row_id").collect()
    assert [(r.answer, r.original_answer) for r in got] == [("unknown", "address"), ("other art", "film"), ("a", None)]
    assert "miscellaneous" not in got[1].prompt and got[0].prompt.count(",") == 3


def test_stages_keep_their_laws(spark):
    t = Taxonomy.of()
    rows = [x for i in range(60) for p in [t.path(sorted(t.leaf_parent())[i * 2])] for x in ((t.options(1, p[0]), p[0]), (t.options(2, p[1]), p[1]), (t.options(3, p[2]), p[2]))]
    d = options(spark, *rows)
    merged = dynamic.merge(d, t)
    assert 120 <= merged.count() < 180
    for stage in (dynamic.swap_synonyms, dynamic.reduce_options):
        out = stage(d, t)
        assert out.count() == 180 and out.where(~F.array_contains(T.tail_options(F.col("prompt")), F.col("answer"))).count() == 0
    assert dynamic.reduce_options(d, t).where(F.size(T.tail_options(F.col("prompt"))) < 2).count() == 0
    done = dynamic.pipeline(d, t)
    assert done.count() == merged.count() and sorted(map(str, done.collect())) == sorted(map(str, dynamic.pipeline(d.repartition(7), t).collect()))
    q = d.select("row_id", F.col("prompt").alias("query"), F.col("answer").alias("response"))
    compat = dynamic.random_variant(q, t, {})
    assert compat.count() == 180 and dynamic.random_variant(q.withColumn("query", F.lit("no list")), t).where("query <> 'no list'").count() == 0


def test_samples(spark):
    d = spark.createDataFrame([(i, f"c{i % 4}") for i in range(40)] + [(99, "rare")], "id int, c string")
    n = lambda size: {r.c: r["count"] for r in sampling.stratified(d, "c", "id", size).groupBy("c").count().collect()}
    assert n(10) == {"c0": 2, "c1": 2, "c2": 2, "c3": 2, "rare": 1} and n(13)["c0"] == 3 and n(12)["c1"] == 2
    pairs = spark.createDataFrame([(p, h, f"a{p % 2}") for p in range(10) for h in (0, 1)] + [(50, 1, "a9")], "pair int, half int, answer string")
    assert sampling.uniform_pairs(pairs, 90).groupBy("pair").count().where("count = 2").count() == 2
    a = one(sampling.agreement(spark.createDataFrame([("S",), ("n",), ("s ",), ("S",)], "f string"), "f"))
    assert (a.n, a.agreed, a.share) == (4, 3, 0.75)


def test_quality(spark):
    leaves = Taxonomy.of().leaf_table(spark)
    found = spark.createDataFrame([("a", "city"), ("a", "city"), ("b", "film"), ("b", "??")], "file string, category string")
    assert {tuple(r) for r in quality.counts(found).collect()} == {("a", 2, 1), ("b", 2, 2), (None, 4, 3)}
    assert [tuple(r) for r in quality.unknown(found, leaves).collect()] == [("??", 1)]
    assert tuple(one(quality.summary(found, leaves)))[:3] == (155, 2, 153)
    assert [r.category for r in quality.thin(found, leaves).collect()] == ["film", "city"]
    rec = spark.createDataFrame([("x y", [("x", "city"), ("q", "city"), ("y", "zz")]), ("", [("x", "city")]), ("k", [("m", "city")]), ("k", None)], "text string, entities array<struct<text:string,category:string>>")
    good, stats = quality.filter_synthetic(rec, leaves)
    assert one(good).entities[0].text == "x" and one(good).source == "synthetic" and tuple(one(stats)) == (2, 1, 2, 1)
    need = quality.gaps(found, leaves, below=2, parents=["other art", "geo-political entity"], done=found.where("category = 'film'"))
    assert {r.category for r in need.collect()} == {"play", "broadcast program", "game", "other art", "continent", "country", "state or province", "district", "region", "other gpe"}
    b = quality.batches(need, Taxonomy.of(), 4).orderBy("parent_ord", "batch").collect()
    assert [r.leaves for r in b] == [["continent", "country", "state or province", "district"], ["region", "other gpe"], ["play", "broadcast program", "game", "other art"]]
    p = quality.generation_prompt(spark.createDataFrame([("p", ["a", "b"])], "parent string, leaves array<string>"), 3, "{parent} {per_category} {total}", {"a": "hint"})
    assert one(p).prompt == '- "a": hint\n- "b"\n\np 3 6'
    good, failed = quality.accepted_synonyms(spark.createDataFrame([("a",), ("b",), ("c",)], "category string"), spark.createDataFrame([("a", " X. "), ("b", "B"), ("z", "q"), ("c", "")], "category string, synonym string"))
    assert [tuple(r) for r in good.collect()] == [("a", "x")] and {r.category for r in failed.collect()} == {"b", "c"}


def test_scores(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "id string, entity string, category string")
    t = pairs([("s1", "roma", "city"), ("s1", "dante", "author"), ("s2", "Fiat", "company")])
    p = pairs([("s1", "Roma", "city"), ("s1", "dante", "artist"), ("s2", "fiat", "company"), ("s2", "roma", "city"), ("s9", "x", "y")])
    r = one(evaluation.score(t, p, ["entity", "category"]))
    assert (r.tp, r.n_predicted, r.n_truth, round(r.f1, 4)) == (2, 3, 3, 0.6667)
    assert one(evaluation.score(t, p, ["entity", "category"], strict=True)).precision == 0.5
    e = one(evaluation.score(t, p, ["entity"]))
    assert (e.precision, e.recall, round(e.f1, 4)) == (0.75, 1.0, 0.8571)
    z = one(evaluation.score(t, p.where("false"), ["entity"]))
    assert (z.precision, z.recall, z.f1) == (0.0, 0.0, 0.0)
    b = spark.createDataFrame([("s", ["A", "b", "c"], ["X", "y"])], "id string, entity array<string>, category array<string>")
    assert {tuple(r) for r in evaluation.pairs(b).collect()} == {("s", "a", "x"), ("s", "b", "y")}
    assert evaluation.report(t, p).count() == 2


def test_cascade(spark):
    t = Taxonomy.of()
    e = spark.createDataFrame([(1, 0, "x", "x y"), (1, 1, "y", "x y"), (2, 0, "a", "a b"), (2, 1, "b", "a b")], "id int, pos int, entity string, sentence string")
    says = {("x", "person"): "PERSON", ("y", "person"): "unknown", ("x", "real person"): "real person", ("x", "politician"): "Artist", ("a", "person"): "nonsense", ("b", "person"): "person", ("b", "real person"): "real person", ("b", "politician"): "artist"}

    def load():
        def model(asked):
            return [says[q.split("##")[1], q.split("list: ")[1].split(",")[0]] for q in asked]

        return model

    got = {(r.id, r.pos): r.category for r in cascade.classify(e, t, cascade.batched(load)).collect()}
    assert got == {(1, 0): "artist", (1, 1): "unknown", (2, 0): "unknown", (2, 1): "unknown"}
    q = spark.createDataFrame([("b",), ("a",), ("c",)], "query string")
    ref = spark.createDataFrame([("b", "old", 0), ("b", "new", 1)], "sentence string, id string, ord int")
    assert {(r["query"], r.id) for r in cascade.named(q, ref).collect()} == {("b", "new"), ("a", "sentence1"), ("c", "sentence2")}


def test_numbering(spark):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(7)
    assert [r.n for r in numbered(d, "k").orderBy("k").collect()] == list(range(1000))


def test_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    rec = {"text": "a è", "entities": [{"text": "è", "start": 0, "end": 0, "category": "city"}]}
    lines = put("r.jsonl", json.dumps(rec, ensure_ascii=False) + "\n\n{bad\n" + json.dumps(rec | {"source": "synthetic"}) + "\n")
    rows, bad = corpus.read_json(spark, lines, corpus.RECORD)
    assert rows.count() == 2 and [r.value for r in bad.collect()] == ["{bad"]
    array = put("a.json", "\n [" + json.dumps(rec) + ",\n" + json.dumps(rec) + "]")
    assert corpus.read_json(spark, array, corpus.RECORD)[0].count() == 2
    assert [r.file_ord for r in corpus.read_records(spark, lines, array).orderBy("file_ord").collect()] == [0, 0, 1, 1]
    keyed = put("b.json", json.dumps({"sentence1": {"sentence": "s", "entity": ["x", "y"], "category": ["city"]}, "sentence2": {"sentence": "t", "entity": [], "category": []}}))
    b = corpus.read_base(spark, keyed).orderBy("ord").collect()
    assert [(r.sentence_id, len(r.mentions)) for r in b] == [("sentence1", 1), ("sentence2", 0)]
    assert {(r.file[-2:], r.category) for r in corpus.read_categories(spark, lines, keyed).collect()} == {("nl", "city"), ("on", "city")}
    with pytest.raises(ValueError):
        corpus.read_categories(spark, "x.csv")
    assert corpus.resolve(spark, f"file://{tmp_path}/r.json").endswith("r.jsonl")
    with pytest.raises(FileNotFoundError):
        corpus.resolve(spark, f"file://{tmp_path}/none")
    (tmp_path / "resp").mkdir()
    put("resp/1.jsonl", '{"query":"q","response":"##a##"}\n{"prompt":"q","query":"","output":"##b##"}\n')
    put("resp/2.jsonl", '{"input":"z","text":""}\nbroken\n')
    got = corpus.read_responses(spark, f"file://{tmp_path}/resp").orderBy("ord").collect()
    assert [(r["query"], r.response) for r in got] == [("q", "##a##"), ("q", "##b##")]
    mixed = put("m.json", "[" + json.dumps(rec) + ', 7, {"text": ["no text"]}, null, ' + json.dumps(rec) + "]")
    rows, bad = corpus.read_json(spark, mixed, corpus.RECORD)
    assert rows.count() >= 2 and "7" in [r.value for r in bad.collect()] and rows.where("text = 'a è'").count() == 2
    assert [r.value for r in corpus.read_json(spark, put("c.json", "[{broken"), corpus.RECORD)[1].collect()] == ["[{broken"]
    rows = corpus.read_json(spark, lines, corpus.RECORD)[0]
    assert corpus.write_jsonl(rows, f"file://{tmp_path}/out").count() == 2
    corpus.write_base(corpus.read_base(spark, keyed), f"file://{tmp_path}/base")
    audit = spark.createDataFrame([(1, "dev", 'a "b", c', "e", "city")], "id int, split string, sentence string, entity string, category string")
    corpus.write_audit(audit, f"file://{tmp_path}/audit")
    assert one(corpus.read_audit(spark, f"file://{tmp_path}/audit")).sentence == 'a "b", c'
    for s in ("train", "dev", "test"):
        put(f"{s}.jsonl", "{}\n\n{}\n")
    assert corpus.copy_splits(spark, f"file://{tmp_path}", f"file://{tmp_path}/copy") == {"train": 2, "dev": 2, "test": 2}
    assert one(corpus.rename_splits(spark.createDataFrame([("validation",)], "split string"))).split == "dev"
    blocks = spark.createDataFrame([(0, "x" * 30), (7, "Header " + "y" * 50), (7, "z" * 50), (20, "w" * 50)], "page int, block string")
    assert corpus.blocks(blocks, "header", 40, 6, 10).count() == 1


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:09", "a"), ("2024-01-01 00:01:00", "b")], "t string, answer string").selectExpr("cast(t as timestamp) t", "answer")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    for name, q, mode in (("plain", answer_counts(stream()), "complete"), ("wide", windowed_counts(stream(), "t", "10 seconds", "1 minute"), "complete")):
        run = q.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("plain").collect()} == {("a", 2), ("b", 1)}
    assert {(r.answer, r.n) for r in spark.table("wide").collect()} == {("a", 2), ("b", 1)}
