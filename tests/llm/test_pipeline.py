import numpy as np
from test_linededup import brute as line_brute
from test_quality import slow_verdicts
from test_simhash import brute as simhash_brute
from test_simhash import slow_fingerprint

import corpus_pipeline
from cloakframe.llm import decontaminate


def aligned(text, items):
    """Whether a text aligns with an item, without seeds: every item against the whole text."""
    numbers = {}
    number = lambda ws: [numbers.setdefault(w, len(numbers)) for w in ws]
    body = number(decontaminate.tokens(text))
    segments = [number(x) for x in items]
    if not body:
        return False
    rules = decontaminate.AlignmentRules()
    best, _ = decontaminate.smith_waterman(decontaminate.padded(segments, -1), np.tile(np.array(body, np.int32), (len(items), 1)), rules)
    return any(b / (2 * len(s)) >= rules.min_score for b, s in zip(best, segments, strict=True))


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        stages.append((rows, docs.collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    texts = lambda rows: sorted((r.doc_id, r.text) for r in rows)

    before, after = stages[0]
    verdicts = slow_verdicts([(r.doc_id, r.source, r.text) for r in before])
    assert texts(after) == texts(r for r in before if verdicts[r.doc_id][1])

    before, after = stages[1]
    assert texts(after) == sorted((i, t) for i, t, _, _ in line_brute([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = stages[2]
    pairs = [(r.doc_id, slow_fingerprint(r.text)) for r in before]
    least = simhash_brute(pairs)
    assert texts(after) == texts(r for r, (_, f) in zip(before, pairs, strict=True) if least[f] == r.doc_id)

    before, after = stages[3]
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert all(8 <= len(x) <= 64 for x in items)
    assert texts(after) == texts(r for r in before if not aligned(r.text, items))

    before, after = stages[4]
    assert set(texts(after)) < set(texts(before)) and all(0 < r.prob <= 1 and r.weight > 0 for r in after)
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.select(docs.columns).collect())) == sorted(map(tuple, after))
