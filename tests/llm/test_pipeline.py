"""The pipeline stage by stage against plain versions, on the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline as P
from tagforge.llm import mixing
from tagforge.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    cols = docs.columns
    s = dict(P.STAGES)
    assert list(s) == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "bpe"]

    a = written(s["language_id"](spark, docs, SF), "a")
    assert a.columns == cols and a.count() == docs.where("text rlike '[\\\\p{L}]'").count()

    b = written(s["exact_dedup"](spark, a, SF), "b")
    groups = defaultdict(list)
    for r in a.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert b.columns == cols and sorted(r.doc_id for r in b.collect()) == sorted(min(g)[1] for g in groups.values())

    c = written(s["ngram_jaccard_join"](spark, b, SF), "c")
    rows = {r.doc_id: r.text.lower().split() for r in b.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in rows.items()}
    root = {k: k for k in sets}
    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y]):
                lo, hi = sorted((root[x], root[y]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert c.columns == cols and sorted(r.doc_id for r in c.collect()) == sorted(set(root.values()))

    d = written(s["mixing"](spark, c, SF), "d")
    taken = mixing.mix(c, mixing.label_quality(table(spark, SF, "labels"))).collect()
    assert d.columns == cols and sum(len(r.text.split()) for r in d.collect()) == sum(r.taken for r in taken)

    e = s["bpe"](spark, d, SF)
    assert e.count() == d.count() and e.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_of_odd_rows(spark):
    """Null, empty and repeated rows, and empty tables, pass every stage; the last stages against plain versions."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    schema = table(spark, SF, "documents").schema
    words = "the people of that small town were walking along the river and they talked about their houses and gardens while others worked".split()
    text = " ".join(words * 4)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, "en", "a", None), (3, "", None, None, 0), (None, text + " end", "en", "b", 1), (4, "12 34", "en", "b", 5), (5, " ".join(words[::-1]), "en", None, 3), (6, text.upper(), None, "a", 2)]
    docs = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*[docs[f.name].cast(f.dataType) for f in schema.fields])
    s = dict(P.STAGES)
    a = written(s["language_id"](spark, docs, SF), "a")
    assert sorted(r.doc_id or 0 for r in a.collect()) == [0, 1, 1, 5, 6]
    b = written(s["exact_dedup"](spark, a, SF), "b")
    assert sorted(r.doc_id or 0 for r in b.collect()) == [0, 1, 5, 6]
    c = written(s["ngram_jaccard_join"](spark, b, SF), "c")
    # upper case makes no other shingles, and one more word leaves 0.98 of them
    assert sorted(r.doc_id or 0 for r in c.collect()) == [1, 5]
    d = written(s["mixing"](spark, c, SF), "d")
    taken = {(r.doc_id, r.of): r.taken for r in mixing.mix(c.withColumnRenamed("source", "of").selectExpr("*", "of as source"), mixing.label_quality(table(spark, SF, "labels")), keep=("of",)).collect()}
    got = defaultdict(int)
    for r in d.collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert dict(got) == {k: v for k, v in taken.items() if v}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    want = []
    for r in d.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in s["bpe"](spark, d, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
