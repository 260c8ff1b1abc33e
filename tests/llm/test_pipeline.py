"""The corpus pipeline against brute force, stage by stage, and on awkward rows and empty tables."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, quality
from tests.llm.helpers import AWKWARD, SF, awkward, empty, key
from tests.llm.test_exact import hits, joined, judged, sha

BIG = "/root/testdata/sf0.01"


def masked(text, spans):
    """text with a mask for each span; spans that overlap share one."""
    groups = []
    for a, b in sorted(spans):
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(b, groups[-1][1])
        else:
            groups.append([a, b])
    for a, b in reversed(groups):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def redacted(rows):
    """rows (doc_id, text, source, lang), with the text masked where the whole corpus says that it's a secret."""
    for (i, text, source, lang), said in zip(rows, judged(rows), strict=True):
        spans = [tuple(map(int, s.split(":")[1:])) for s in said[5].split(",") if s]
        yield i, masked(text, spans) if text else text, source, lang


def encoded(rows):
    library = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.ranks(bpe.vocabulary_path()), special_tokens={})
    for i, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        yield i, len(ids) // 4, sha(ids), sha((text or "").encode()), ids


def unlinked(rows):
    """The row with the smallest doc_id of each group of near duplicates; texts without words are in none."""
    return [r for r, (i, n, least) in zip(rows, joined([r[:2] for r in rows]), strict=True) if not n or i == least]


def test_run_by_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{BIG}/{name}.parquet") for name in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.scores(docs, quality.fit(docs, labels)).filter(F.col("score") >= quality.THRESHOLD).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    left = [len(rows)]
    rows = [r for r in rows if r[0] in good]
    left.append(len(rows))
    rows = unlinked(rows)
    left.append(len(rows))
    found = list(hits([r[:2] for r in rows], [tuple(r) for r in bench.select("item_id", "text").collect()]))
    rows = [r for r, said in zip(rows, found, strict=True) if not said[2]]
    left.append(len(rows))
    assert all(a > b for a, b in zip(left, left[1:], strict=False)) and left[-1] > left[0] // 3
    final = list(redacted(rows))
    assert final != rows
    got = corpus_pipeline.run(spark, BIG).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert key((*r[:4], bytes(r.ids)) for r in got) == key(encoded(final))


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_rows_and_none(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = awkward(spark, extra=True)
    for df in (docs, docs.filter("false")):
        made = stage(spark, df, SF)
        rows = made.collect()
        if df is not docs:
            assert not rows
        elif name == "tokens":
            assert key((*r[:4], bytes(r.ids)) for r in made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()) == key(encoded(AWKWARD))
        elif name == "secrets":
            assert key((r.doc_id, r.text) for r in rows) == key((i, t) for i, t, *_ in redacted([(i, t, f"src{(i or 0) % 3}", "en") for i, t in AWKWARD]))
        elif name != "quality":
            wordless = lambda found: sum(not (t or "").strip() for _, t in found)
            assert wordless((r.doc_id, r.text) for r in rows) == wordless(AWKWARD)
        assert name == "tokens" or made.columns == df.columns


def test_stages_keep_the_columns_of_documents(spark):
    plain = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, SF).schema.simpleString() == plain.schema.simpleString()
