"""SimHash and vectors, against brute force."""

import random

import numpy as np
import xxhash

from quarry.llm import simhash, vector_dedup, vector_search
from quarry.llm.common import Scratch

from .helpers import documents, odd_texts, rows_of, words


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least_labels(ids, near):
    lab = list(range(len(ids)))
    while True:
        new = [min(lab[j] for j in range(len(ids)) if near(i, j)) for i in range(len(ids))]
        if new == lab:
            break
        lab = new
    least = {}
    for i, n in zip(lab, ids):
        least[i] = min(least.get(i, n), n)
    return [least[i] for i in lab]


def test_op9(spark, tmp_path):
    r = random.Random(5)
    texts = odd_texts()
    base = [words(r, 60) for _ in range(6)]
    for b in base:
        w = b.split()
        for k in range(5):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = words(r, 1)
            texts.append("  ".join(v).upper() if k % 2 else " ".join(v))
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    rows = [*zip(ids, texts), (ids[3], texts[20])]
    sf = documents(spark, tmp_path, rows)
    got = rows_of(simhash.op9_simhash(spark, sf), "doc_id", "fingerprint", "component_id")
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = least_labels([d for d, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comp)), key=repr)
    assert simhash.op9_simhash(spark, documents(spark, tmp_path / "e", [])).count() == 0


def test_balls_lose_no_connection(spark):
    r = random.Random(6)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(3):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
            f = g
    fps = sorted(fps)
    s = Scratch(spark, "t")
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    likely = simhash.may_have_partner(df)
    named = {x["node"]: x["component"] for x in simhash.connected_components(s, simhash.ball_links(likely)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = least_labels(signed, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [named.get(f, f) for f in signed] == want


def vectors(spark, folder, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS label", "'x' AS vec", "'y' AS links", "'z' AS list")
    df.write.mode("overwrite").parquet(f"file://{folder}/embeddings.parquet")
    return f"file://{folder}"


def clustered(seed, n, dim, copies, spread):
    r = np.random.default_rng(seed)
    x = [r.normal(size=dim) for _ in range(n)]
    for c in range(copies):
        x.append(x[c % 7] + spread * r.normal(size=dim))
    return [v.tolist() for v in x]


def brute_links(ids, x, least=0.95):
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, True)
    return near.sum(1) - 1, least_labels(ids, lambda i, j: near[i, j])


def test_op4(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 20)  # large buckets in tiles
    x = clustered(7, 120, 24, 90, 0.25)
    x += [x[0]] * 5
    x = [[float(np.float32(c)) for c in v] for v in x]
    ids = list(range(1000, 1000 + len(x)))
    odd = [(1, None), (2, [0.0] * 24), (3, [float("nan")] + [1.0] * 23), (4, [None] + [1.0] * 23), (5, [float("inf")] + [1.0] * 23), (6, [])]
    sf = vectors(spark, tmp_path, [*zip(ids, x), *odd])
    n, comp = brute_links(ids, x)
    got = rows_of(vector_dedup.op4_vector_dedup(spark, sf), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([*((i, int(k), c, i == c) for i, k, c in zip(ids, n, comp)), *((i, 0, i, True) for i, _ in odd)], key=repr)
    assert max(n) > 10
    assert vector_dedup.op4_vector_dedup(spark, vectors(spark, tmp_path / "e", [])).count() == 0


def test_op4_short_vectors_and_one_row(spark, tmp_path):
    sf = vectors(spark, tmp_path, [(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (3, [0.0, 1.0])], "double")
    assert rows_of(vector_dedup.op4_vector_dedup(spark, sf), "vec_id", "n_links", "component_id") == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 2, 1)]
    assert rows_of(vector_dedup.op4_vector_dedup(spark, vectors(spark, tmp_path / "o", [(9, [1.0, 2.0])])), "vec_id", "n_links", "kept") == [(9, 0, True)]


def at_the_bound(seed, n, dim, spread):
    """Unit vectors that share a direction, a third of them close to it, and for each one at cosine 0.95."""
    r = np.random.default_rng(seed)
    d = r.normal(size=dim)
    d /= np.linalg.norm(d)
    x = np.concatenate([d + spread * r.normal(size=(n // 3, dim)), d + 5 * spread * r.normal(size=(n - n // 3, dim))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, u, vector_dedup.at_cosine(u, 0.95, r)


def test_op4_tables_and_radius_find_pairs_next_to_the_mean():
    for spread in (0.02, 0.2):
        x, u, near = at_the_bound(1, 6000, 64, spread)
        assert np.allclose((u * near).sum(1), 0.95)
        for rows in (3000, 1_000_000):
            codes = vector_dedup.Codes(x, rows)
            a, b = codes.keys(u), codes.keys(near)
            assert (a == b).any(1).all()
            apart = (codes.unpacked(codes.sketches(a)) != codes.unpacked(codes.sketches(b))).sum(1)
            assert apart.max() <= codes.radius


def test_op4_rotations_are_learned_and_balanced():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 32))
    x = centres[r.integers(0, 40, 4000)] + 0.3 * r.normal(size=(4000, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    turn = vector_dedup.rotations(u, 32, np.random.default_rng(5), None)
    assert np.allclose(turn.T @ turn, np.eye(32), atol=1e-9)
    loss = lambda t: np.square(np.sign(u @ t) / np.sqrt(32) - u @ t).sum()
    drawn = [np.linalg.qr(r.normal(size=(32, 32)))[0] for _ in range(8)]
    assert loss(turn) < min(map(loss, drawn))
    d = u.mean(0) + 3 * centres[0]
    d /= np.linalg.norm(d)
    v = u + 2 * d
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = v.mean(0) / np.linalg.norm(v.mean(0))
    share = lambda mean: np.abs((v @ vector_dedup.rotations(v, 64, np.random.default_rng(6), mean) >= 0).mean(0) - 0.5).mean()
    assert share(m) < 0.15 < share(None)


def brute_search(rows, step, k=10):
    out = {}
    for q, v in rows:
        if q % step == 0:
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = d[:k]
    return out


def test_op10(spark, tmp_path):
    x = clustered(8, 900, 32, 60, 0.1)
    x += [x[0]] * 30  # ties
    x = [[float(np.float32(c)) for c in v] for v in x]
    rows = list(enumerate(x))
    sf = vectors(spark, tmp_path, [*rows, (10_000, None), (10_100, [0.0] * 32), (20_000, [float("nan")] * 32), (None, x[1])])
    got = {}
    for r in vector_search.op10_vector_search(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    want = brute_search(rows, 100)
    assert set(got) == set(want)
    hits = 0
    for q, d in want.items():
        assert [r[2] for r in got[q]] == list(range(1, 11)) and [r[:2] for r in got[q]] == sorted(r[:2] for r in got[q])
        hits += len({i for _, i in d} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i, _ in got[0]] == [i for _, i in want[0]]  # all at distance 0: the smallest ids


def test_op10_repeated_ids(spark, tmp_path):
    """A query is compared with every row but its own, also with those of its id; each row of a query id is a query."""
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[30]), (0, x[31]), (100, x[100]), (7, x[7]), (7, x[8])]
    got = {}
    for g in vector_search.op10_vector_search(spark, vectors(spark, tmp_path, rows)).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["score"], g["vec_id"]))
    want = {}
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), n) for j, (n, w) in enumerate(rows) if j != i)[:10]
            want.setdefault(q, []).extend((k + 1, d, n) for k, (d, n) in enumerate(near))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()} == {0: 30, 100: 20}
    hits = sum(len({(round(d, 9), n) for _, d, n in got[q]} & {(round(d, 9), n) for _, d, n in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len({(round(d, 9), n) for _, d, n in v}) for v in want.values())
    for v in got.values():
        assert sorted(k for k, _, _ in v) == sorted([*range(1, 11)] * (len(v) // 10))


def test_op10_second_level_lists():
    """Cells cut again: probing finds at least nine in ten, and every row is in one list."""
    r = np.random.default_rng(10)
    x = r.normal(size=(3000, 16))
    lists = vector_search.Lists(x, 3000, tops=12)
    assert len(lists.subs) > 1 and lists.number == len(lists.tops) * len(lists.subs)
    own = lists.assign(x)
    sizes = np.bincount(own, minlength=lists.number)
    found = 0
    for q in range(0, 3000, 60):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        probed = lists.probe(x[q], sizes, 10)
        assert len(set(probed)) == len(probed) < lists.number
        found += np.isin(own[np.argsort(d)[:10]], probed).sum()
    assert found >= 0.9 * 500
    assert sorted(lists.order(x[0], len(lists.tops)).tolist()) == list(range(lists.number))


def test_op10_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for g in vector_search.op10_vector_search(spark, sf).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_op10_few_and_none(spark, tmp_path):
    sf = vectors(spark, tmp_path, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5])])
    assert rows_of(vector_search.op10_vector_search(spark, sf), "query_id", "rank", "vec_id") == [(0, 1, 2), (0, 2, 2), (0, 3, 1)]
    assert vector_search.op10_vector_search(spark, vectors(spark, tmp_path / "e", [])).count() == 0
