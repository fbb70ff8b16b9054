"""Spans from marked responses, and their merging."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<text:string,start:int,end:int>>"


def extract(sentence: Column, response: Column) -> Column:
    """(text, start, end) of what a response marks, placed at its first occurrence; what the sentence lacks is left out."""
    found = F.transform(F.regexp_extract_all(response, F.lit(r"(?d)##(.*?)##"), F.lit(1)), lambda t: F.struct(t.alias("text"), (F.instr(sentence, t) - 1).alias("start"), (F.instr(sentence, t) - 1 + F.length(t)).alias("end")))
    return F.filter(found, lambda s: s["start"] >= 0)


def overlap(a: Column, b: Column) -> Column:
    return ~((a["end"] <= b["start"]) | (a["start"] >= b["end"]))


def merge(spans: Column) -> Column:
    """Spans folded in order: one that meets a held span replaces the first such if it is wider, else goes; others are held."""

    def step(held, x):
        at = F.array_position(F.transform(held, lambda h: overlap(h, x)), True)
        wider = lambda h: x["end"] - x["start"] > h["end"] - h["start"]
        swapped = F.transform(held, lambda h, i: F.when((i + 1 == at) & wider(h), x).otherwise(h))
        return F.when(at > 0, swapped).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(spans, F.array().cast(SPANS), step)


def folded(sentence: str, responses: Iterable[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """merge() of what responses, each so many times in a row, mark in a sentence.

    A response is folded again only as long as that changes what is held.
    """
    held: list[tuple[str, int, int]] = []
    taken = bytearray(len(sentence))  # where held spans are or were
    for response, n in responses:
        found = [(t, a, a + len(t)) for t in re.findall(r"##(.*?)##", response) if (a := sentence.find(t)) >= 0]
        for _ in range(n):
            before, idle = (len(held), sum(b - a for _, a, b in held)), set()
            for x in found:
                if x in idle:
                    continue
                _, a, b = x
                at = next((i for i, (_, c, d) in enumerate(held) if not (c >= b or d <= a)), -1) if 1 in taken[a:b] else -1
                if at < 0:
                    held.append(x)
                elif b - a > held[at][2] - held[at][1]:
                    held[at] = x
                else:
                    idle.add(x)
                    continue
                idle.clear()
                taken[a:b] = b"\1" * (b - a)
            # spans are only added or made wider
            if before == (len(held), sum(b - a for _, a, b in held)):
                break
    return held


def fold(query: Column, responses: Column) -> Column:
    """folded() in batches of an array of (response, n) in order."""

    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or any(v["response"] is None for v in y) else [{"text": t, "start": a, "end": b} for t, a, b in folded(x, ((v["response"], v["n"]) for v in y))] for x, y in zip(q, r, strict=True)], dtype=object)

    return F.pandas_udf(run, SPANS)(query, responses)


def merged_responses(rows: DataFrame) -> DataFrame:
    """(query, spans) of responses (query, ord, response), folded in their order. Equal ones are counted before a query's are put together."""
    n = rows.groupBy("query", "ord", "response").agg(F.count("*").alias("n"))
    g = n.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "response", "n"))).alias("r"))
    return g.select("query", fold(F.col("query"), F.transform("r", lambda x: F.struct(x["response"].alias("response"), x["n"].alias("n")))).alias("spans"))
