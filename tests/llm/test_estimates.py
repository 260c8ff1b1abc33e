"""Collocations, licenses and whitening against brute force."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import collocations, licenses, whitening
from tessera.llm.oracles import COLLOCATIONS
from tests.llm.helpers import AWKWARD, LETTERS, LOWER, SF, awkward, documents, empty, key


def counted(rows, longest):
    """(lang, words) -> occurrences, lang -> words."""
    found, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            found.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return found, n


def best(rows, least, longest, most):
    found, n = counted(rows, longest)
    candidates = {p: a for p, a in found.items() if len(p[1]) > 1 and a >= least}
    inside = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= found[lang, w[i:j]]}
    scored = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (found[lang, w[:k]] * found[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), " ".join(w), a, found[lang, w[:k]], found[lang, w[k:]], n[lang], score))
    return [(lang, i, *x[3:]) for lang, rows in scored.items() for i, x in enumerate(sorted(rows)[:most], 1)]


@pytest.fixture
def small(monkeypatch):
    """Many blocks, and parts of the streams that cut between a phrase and its extensions."""
    monkeypatch.setattr(collocations, "BLOCK", 2_000)
    monkeypatch.setattr(collocations, "PART", 20_000)
    monkeypatch.setattr(collocations, "STREAM", 7)


def test_collocations_by_brute_force(spark, small):
    rows = [("en" if (i or 0) % 2 else None, t) for i, t in AWKWARD] + [("en", "a b c a b c, a\tb\x0bc. A B"), ("und", "one one one one one one one"), ("x\ny\\", "\x01a b a \x01b \x01a b a \x01b"), ("x\ny\\", "a a\x01 a a\x01 a\x01 a a a")] * 3
    docs = spark.createDataFrame([(*r, "c") for r in rows], "lang string, text string, words string")
    for least, longest, most in ((2, 5, 2000), (3, 3, 4), (50, 5, 9)):
        assert key(collocations.collocations(docs, least, longest, most).collect()) == key(best(rows, least, longest, most))


def test_collocations_of_documents(spark):
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = key(collocations.collocations(docs, 20).collect())
    assert got == key(best(rows, 20, 5, 2000)) and len(got) > 100
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert key(c.execute(COLLOCATIONS.replace(">= 100)", ">= 20)")).fetchall()) == got


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(awkward(spark).filter("text is null")).count() == 0


def meaning(tokens):
    """A license expression by recursive descent."""

    def either():
        out = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            out = licenses.joined("or", out, both())
        return out

    def both():
        out = less()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            out = licenses.joined("and", out, less())
        return out

    def less():
        out = one()
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            out = licenses.joined("with", out, one())
        return out

    def one():
        token = tokens.pop(0)
        if token != "(":
            return licenses.family(token)
        out = either()
        tokens.pop(0)
        return out

    return either()


def test_expressions_by_recursive_descent():
    random = np.random.default_rng(5)
    names = ["mit", "gpl-2.0-only", "apache-2.0", "cc-by-nc-4.0", "0bsd", "lgpl-2.1+", "nobody-knows", "cc0-1.0"]

    def made(depth):
        kind = random.integers(5) if depth else 0
        if kind < 2:
            return [str(random.choice(names))]
        if kind == 2:
            return ["(", *made(depth - 1), ")"]
        return [*made(depth - 1), str(random.choice(["or", "and", "with"])), *made(depth - 1)]

    for _ in range(300):
        tokens = made(5)
        said = "x SPDX-License-Identifier: " + " ".join(tokens).replace("( ", "(").replace(" )", ")").upper() + " */ int main\n"
        (found,) = licenses.expressions(said)
        want = meaning(list(tokens))
        assert (found.labels, found.restricts) == (sorted(want.labels), want.restricts)
    cases = {"mit or": "mit", "((mit and": "((mit", ") mit": None, "": None, "mit ) or isc": "mit", "mit license-expression: isc": "mit", "mit isc": "mit", "(mit) isc": "(mit)", "mit or\nisc": "mit"}
    for text, want in cases.items():
        found = [e.text for e in licenses.expressions("spdx-license-identifier:" + text)]
        assert found[:1] == ([want] if want else []), text
    assert licenses.family("gpl-3.0-or-later").labels == {"gpl"} and licenses.family("cc-by-nc-sa-4.0").labels == {"cc-by-nc"} and not licenses.family("mitre").labels


def test_licenses_by_brute_force(spark):
    extra = ["Licensed under CC BY-NC 4.0. cc by cc, by; CC BY", "GNU Lesser General Public License\nall RIGHTS reserved. All rights reserved", "# SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause", "ccby général public license", "cc  by" * 3000]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, places string")
    phrases = {**licenses.NOTICES, **licenses.BASE}
    want = []
    for i, t in rows:
        words = LETTERS.findall((t or "").translate(LOWER))
        at = sorted((s, p) for p in phrases for s in range(len(words)) if words[s] == p.split()[0] and words[s : s + p.count(" ") + 1] == p.split())
        base = [s for s, p in at if p in licenses.BASE]
        labels = {phrases[p] for _, p in at}
        said = [meaning([x for x in re.split(r"\s+|([()])", m.lower()) if x]) for m in re.findall(r"SPDX-License-Identifier: (.*)", t or "")]
        score = max([0.0, *(licenses.RESTRICTS[x] for x in labels), *(m.restricts for m in said)])
        labels = labels.union(*(m.labels for m in said))
        want.append((i, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({licenses.BASE[p] for _, p in at if p in licenses.BASE})), ",".join(sorted(labels)), score))
    assert key(licenses.digests(docs).collect()) == key(want)
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [(e.text, list(e.labels), e.restricts) for e in found[102].expressions] == [("(MIT OR GPL-2.0) AND BSD-3-Clause", ["bsd", "gpl", "mit"], 0.1)]
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.op12_licenses(spark, SF).count() == documents(spark).count()


def whitened_by_eigh(vectors, most=4):
    """(rows: (vec_id, x), n, S, variances, axes, total) by the covariance's eigenvectors."""
    width = max((len(v) for _, v in vectors if v is not None), default=0)
    kept = [(i, [*(int(np.floor(256 * float(c))) for c in v), *[0] * (width - len(v))]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, len(fit), [sum(int(c) for c in d) for d in fit.T.tolist()], values[::-1][:most], axes[:, ::-1][:, :most], values.sum()


def same(spark, vectors, kind="float", most=4):
    df = spark.createDataFrame([(i, v, "t") for i, v in vectors], f"vec_id long, embedding array<{kind}>, component string")
    rows = whitening.whitened(df, most=most).collect()
    kept, n, sums, values, axes, total = whitened_by_eigh(vectors, most)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(kept) * len(values) and {r.n for r in rows} == {n}
    for c in range(len(values)):
        sign = 0
        for i, x in kept:
            r = got[i, c + 1]
            want = (np.array(x, float) - np.array(sums) / n) @ axes[:, c] / np.sqrt(values[c])
            sign = sign or (np.sign(want * r.whitened) if abs(want) > 1e-6 else 0)
            assert abs(r.whitened * (sign or 1) - want) < 1e-8 and abs(r.explained / (values[c] / total) - 1) < 1e-10 and r.identity_error < 1e-9
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))


def test_whitening_by_eigenvectors(spark, monkeypatch):
    random = np.random.default_rng(3)
    vectors = [(i, (random.normal(size=9) * np.arange(1, 10)).astype(np.float32).tolist()) for i in range(200)]
    same(spark, vectors + [(300 + i, v) for i, (_, v) in enumerate(vectors[:40] * 3)])  # repeated vectors count once
    monkeypatch.setattr(whitening, "STEP", 9 * 8 * 5)
    monkeypatch.setattr(whitening, "FAN", 2)
    same(spark, vectors, "double", 2)
    same(spark, [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf")]), (6, [0.5, -2.0, 1.0]), (7, [0.25]), (8, [3.0, 1.0, 1.5]), (9, [3.0, 1.0, 1.5]), (10, [-1.0, 4.0, -0.001])], "double", 3)


def test_whitening_of_embeddings(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    kept, n, sums, values, axes, total = whitened_by_eigh(vectors)
    rows = whitening.op13_whitening(spark, SF).collect()
    assert len(rows) == 4 * len(kept)
    by = np.array([[r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component)) if r.component == c] for c in range(1, 5)]).T
    want = (np.array([x for _, x in sorted(kept)], float) - np.array(sums) / n) @ axes / np.sqrt(values)
    assert np.abs(np.abs(by) - np.abs(want)).max() < 1e-8


def test_whitening_of_too_little(spark):
    def of(vectors):
        return whitening.whitened(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, []), (2, [])]) == [] and of([(1, [1.0]), (2, [1.0])]) == []
    rows = of([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (None, [0.0, 0.0])])
    assert {r.deviation for r in rows} == {None} or all(r.component == 1 for r in rows)
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in of([(1, [0.0, 1.0]), (2, [1.0, 0.0])])) == [(1, 1.0), (1, 1.0)]


@pytest.mark.parametrize("made", ["random", "scaled", "low rank", "ties", "wide", "isotropic", "constant"])
def test_qd_solver(made):
    random = np.random.default_rng(11)
    a = {
        "random": lambda: random.normal(size=(300, 40)), "scaled": lambda: random.normal(size=(300, 40)) * np.logspace(0, -6, 40), "low rank": lambda: random.normal(size=(100, 3)) @ random.normal(size=(3, 12)),
        "ties": lambda: np.vstack([np.eye(8), -np.eye(8)]), "wide": lambda: random.normal(size=(5, 30)), "isotropic": lambda: np.linalg.qr(random.normal(size=(300, 20)))[0], "constant": lambda: np.ones((10, 4)),
    }[made]()
    a = a - a.mean(0)
    variances, axes, total = whitening.principal(np.linalg.qr(a, mode="r"), len(a))
    v = a.T @ a / len(a)
    want = np.linalg.eigvalsh(v)[::-1][: len(variances)]
    assert len(variances) == min(4, np.linalg.matrix_rank(a)) and np.allclose(variances, want, rtol=1e-12) and abs(total - np.trace(v)) <= 1e-12 * max(total, 1e-300)
    assert np.abs(axes.T @ axes - np.eye(len(variances))).max(initial=0) < 1e-12 and np.abs(v @ axes - axes * variances).max(initial=0) < 1e-13 * max(want, default=1) * 10
    d, e, _ = whitening.bidiagonal(np.vstack([np.linalg.qr(a, mode="r"), np.zeros((max(0, a.shape[1] - len(a)), a.shape[1]))]))
    assert np.allclose(whitening.dqds(d, e)[: min(a.shape)], np.linalg.svd(a, compute_uv=False), atol=1e-13 * max(1e-300, np.abs(a).max()) * 100)


def test_written_tables_can_be_dropped(spark):
    import os

    from tessera.llm.frames import drop_written, run_dir, written

    assert written(spark.range(3), "kept").count() == 3
    assert os.listdir(run_dir(spark))
    drop_written(spark)
    assert not os.path.exists(run_dir(spark)) and written(spark.range(2), "again").count() == 2
