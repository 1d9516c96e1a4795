import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cloakframe.llm import simhash
from cloakframe.llm.queries import QUERIES

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "The QUICK brown fox\njumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one"),
    (7, "ONE"),
    (8, "two words"),
    (9, "w " * 30_000),
    (10, "w w w w w"),
    (None, "two words"),
    (11, "Ünï cödé ünï cödé"),
    (11, "Ünï cödé ünï cödé"),
]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs):
    """pairs (id, fp): the smallest reachable id of each fingerprint."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


@pytest.mark.parametrize("text", [t for _, t in ROWS])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    want = brute([(i, slow_fingerprint(t)) for i, t in ROWS])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.component == want[r.fp % (1 << 64)]
    kept = sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect())
    assert kept == [0, 1, 3, 6, 8, 9, 11, 11]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_are_all_found(spark):
    """Random fingerprints with chains and dense groups, against all pairs."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(150):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    hub = rng.getrandbits(64)
    fps += [hub ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(200)]
    fps = sorted(set(fps))
    want = brute(list(enumerate(fps)))
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.fp % (1 << 64): r.root for r in simhash.link_classes(nodes).collect()}
    by_root = {}
    for i, f in enumerate(fps):
        by_root.setdefault(roots.get(f, simhash.signed(f)), []).append(i)
    for group in by_root.values():
        assert {want[fps[i]] for i in group} == {min(group)}


def test_query(spark, sf_dir):
    rows = QUERIES["op10_simhash"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pairs = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = brute(list(pairs.items()))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[f]) for i, f in pairs.items()}


@pytest.mark.parametrize("count", [1, 10**5, 10**8, 10**11])
def test_blocks_cover_all_pairs(count):
    blocks = simhash.block_count(count)
    chosen = simhash.masks(blocks)
    rng = random.Random(count)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not diff & m for m in chosen)
