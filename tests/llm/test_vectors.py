"""Hard negatives, centroid clustering and edit embedding against plain programs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtally.llm import clustering, edit_embedding, negatives

VECTORS = "vec_id long, embedding array<double>, label int, q string, node long, score long, id long, want int, cluster int, distance long, k int"
EXTRA = ("q", 0, 0, 0, 0, 0, 0, 0)


def _vectors(n=300, dim=6, seed=5):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        label = rnd.randrange(5)
        rows.append((i, [c + rnd.gauss(0, 0.4) for c in centres[label]] if i % 3 else centres[label], label))
    rows += [(1000 + i, centres[0], i % 2) for i in range(120)]  # a hot vector
    rows += [(2001, None, 1), (2002, [0.1] * dim, None), (2003, [None] * dim, 1), (2004, [float("nan")] * dim, 1), (2005, [float("inf")] + [0.0] * (dim - 1), 1)]
    rows += [(None, [0.1] * dim, 1), (2006, [0.0] * dim, 2), rows[7], rows[7]]
    return rows


def _taking_part(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTORS).repartition(3)


def brute_negatives(rows, step, scale=256):
    kept = {r[0]: (r[2], np.floor(scale * np.array(r[1])).astype(int)) for r in _taking_part(rows, 6) if r[0] is not None and r[2] is not None}
    for a, (label, q) in kept.items():
        if a % step == 0:
            order = sorted((-int(v @ q), i, other == label) for i, (other, v) in kept.items() if i != a)
            for p in [x for x in order if x[2]][:5]:
                within = [x for x in order if not x[2] and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:3]
                yield from ((a, p[1], n + 1, x[1], -p[0], -x[0]) for n, x in enumerate(within))


@pytest.mark.parametrize("cell, tile, answered", [(512, 4096, 65_536), (8, 16, 4)])
def test_op11_matches_brute_force(spark, monkeypatch, cell, tile, answered):
    for name, value in (("CELL", cell), ("TILE", tile), ("ANSWERED", answered)):
        monkeypatch.setattr(negatives, name, value)
    rows = _vectors()
    got = negatives.mine(_frame(spark, rows), F.col("vec_id") % 10 == 0)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(brute_negatives(rows, 10))


def test_op11_visits_few_cells_of_clustered_vectors():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(40, 8)) * 200
    q = np.floor(centres[np.arange(4000) % 40] + rnd.normal(size=(4000, 8)) * 5).astype(np.int64)
    index = negatives.MultiIndex(q, 512 * 400, "<i8")
    codes, apart = index.codes(q)
    for half in (0, 1):
        np.maximum.at(index.radii[half], codes[half], apart[half])
    tile = negatives.Tile(index, np.zeros(4000, int), q, [[i] for i in range(4000)], float)
    one, two = index.bounds(q[:20])
    wants = [{"want": 0, "same": True, "low": -(2**62), "high": 2**62, "k": 6}]
    visited = 0
    for r in range(20):
        cells, seen = tile.cells, []
        tile.cells = lambda *a: (seen.append(c) or c for c in cells(*a))  # noqa: B023
        found = [(s, i) for _, s, i in tile.answer(q[r].astype(float), 0, wants, one[r], two[r])]
        tile.cells = cells
        visited += len(seen)
        score = q @ q[r]
        assert found == [(int(score[i]), int(i)) for i in np.lexsort((np.arange(4000), -score))[:6]]
    assert visited < 0.3 * 20 * len(tile.rows)


def test_op11_empty_and_too_large(spark):
    assert negatives.mine(_frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(_frame(spark, [(1, None, 1)]), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(_frame(spark, [(1, [1e12] * 6, 1)]), F.col("vec_id") % 10 == 0)


def test_op11_fills_up_short_vectors(spark):
    rows = [(0, [1.0, 1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5, 0.25], 2), (3, [], 2)]
    got = negatives.mine(_frame(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r["positive_id"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got] == [(1, 2, 65536, 49152)]


def brute_clusters(rows, k, rounds, dim, scale, seed=1):
    kept = [(r[0], np.floor(scale * np.array(r[1])).astype(int)) for r in _taking_part(rows, dim)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v.tolist() for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1].tolist()))[:k]]
    for turn in range(rounds + 1):
        owner = [min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(np.array(centres)))[::-1] for _, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), o in zip(kept, owner) if o[0] == n]
                if own:
                    centres[n] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    for (i, _), (n, d) in zip(kept, owner):
        yield i, n, d, sum(o[1] for o in owner if o[0] == n), sum(o[1] for o in owner), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()


@pytest.mark.parametrize("k, scale", [(16, 64), (7, 2), (1, 64), (1000, 64)])
def test_op13_matches_brute_force(spark, k, scale):
    rows = _vectors() + [(3000, [1.0], 1)]
    got = clustering.cluster(_frame(spark, rows), k=k, rounds=3, dim=6, scale=scale)
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(brute_clusters(rows, k, 3, 6, scale), key=key)


def test_op13_walks_outward():
    rng = np.random.default_rng(0)
    for n, k, dim in ((400, 16, 64), (300, 5, 3), (200, 1, 4), (300, 7, 1), (1000, 60, 2)):
        vectors, centroids = rng.integers(-6, 7, (n, dim)), rng.integers(-6, 7, (k, dim))
        owner, best, computed = clustering.nearest(vectors, centroids)
        distance = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        assert (owner == distance.argmin(1)).all() and (best == distance.min(1)).all()
        if k > 2 * dim:
            assert computed < n * k / 2  # it stops before it has met every centroid


def test_op13_empty(spark):
    assert clustering.cluster(_frame(spark, []), dim=6).count() == 0
    assert clustering.cluster(_frame(spark, [(1, None, 1)]), dim=6).count() == 0


def walk(text, number):
    goes = np.random.default_rng(12).integers(0, 2, (edit_embedding.WALKS, edit_embedding.CLASSES, edit_embedding.PERIOD), dtype=np.uint8)
    goes[:, :, -1] = 1
    rows, out, at = edit_embedding._rows_of(edit_embedding.code_points(text), number), [], 0
    while at < len(text):
        out.append(ord(text[at]))
        at += int(goes[number, rows[at] // edit_embedding.PERIOD, (len(out) - 1) % edit_embedding.PERIOD])
    return out


def _texts():
    rnd = random.Random(11)
    say = lambda n: " ".join("".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(1, 8))) for _ in range(n))
    base = [say(n) for n in (1, 2, 5, 40, 300, 3000, 40, 41)]
    return [*base, None, "", "日本語 テキスト é ß" * 9, "x" * 70_000, "\x00\x00", base[3], base[3], base[4][:700] + "!" + base[4][701:]]


def test_op12_fingerprints_are_those_of_plain_walks():
    texts = [t or "" for t in _texts()]
    for text, mark in zip(texts, edit_embedding.fingerprints(texts)):
        scale, levels = edit_embedding._levels(mark)
        assert scale == edit_embedding.scale_of(len(text))
        for n, entries in enumerate(levels):
            for number in range(edit_embedding.WALKS):
                out, got = walk(text, number), entries.reshape(edit_embedding.WALKS, -1)[number]
                steps = edit_embedding.drawn_steps(number, scale + n)
                hashed = [int(edit_embedding.mixed(np.array([out[s] * 3 + number + 1], np.uint64))[0] % np.uint64(15)) + 1 if s < len(out) else 0 for s in steps]
                assert got.tolist() == hashed


@pytest.mark.parametrize("copies", [1, 300])
def test_op12_matches_brute_force(spark, copies):
    rows = [(i // 2 if i % 5 == 0 else i, t) for i, t in enumerate(_texts())] + [(None, "no id"), (None, None)]
    rows += [(50, "the same row again and again")] * copies + [(7, "a tie of ids")]
    docs = spark.createDataFrame([(i, t, 0, False, 0, "m") for i, t in rows], "doc_id long, text string, range int, lent boolean, k_row long, mark string").repartition(3)
    # ties are ordered by the hash of the text, so take Spark's
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashed[r[1]]))
    want = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        marks = edit_embedding.fingerprints([text, changed, following])
        digest = hashlib.sha256(changed.encode()).hexdigest()
        want.append((i, len(text), digest, marks[0].hex(), marks[1].hex(), edit_embedding.likeness(*marks[:2]), edit_embedding.likeness(marks[0], marks[2])))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    got = [tuple(r) for r in edit_embedding.with_edits(docs).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op12_likeness_follows_edits():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
    other = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
    few = text[:1000] + "inserted" + text[1003:3000] + text[3001:]
    marks = edit_embedding.fingerprints([text, text, few, edit_embedding.edited(text, other), other])
    same, near, half, apart = (edit_embedding.likeness(marks[0], m) for m in marks[1:])
    assert same == 1 and near > 0.8 and 0.4 < half < 0.7 and apart < 0.25
    # the shorter of two scales apart still meets the longer one
    assert edit_embedding.likeness(*edit_embedding.fingerprints([text[:2040], text[:2060]])) > 0.9


def test_op12_near_texts(spark):
    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = [say(1500) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:700] + say(5) + t[705:]) for i, t in enumerate(base[:10])]
    rows += [(200 + i, base[0]) for i in range(50)] + [(None, base[1]), (300, ""), (301, None)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, node long, group long")
    got = {r["doc_id"]: r["group_id"] for r in edit_embedding.near_texts(docs).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in rows:
        want = 1 if i is None else i - 100 if 100 <= i < 200 else 0 if 200 <= i < 300 else 300 if i in (300, 301) else i
        assert got[i] == want, i


def test_op12_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert edit_embedding.with_edits(docs).count() == 0 and edit_embedding.near_texts(docs).count() == 0
    one = spark.createDataFrame([(4, "only one here")], "doc_id long, text string")
    assert edit_embedding.with_edits(one).select("doc_id", "n_chars", "near_next").collect() == [(4, 13, 1.0)]
