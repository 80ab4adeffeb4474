import random
import sys
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))

from test_near_dedup import brute  # noqa: E402


def corpus(spark):
    draw, docs, labels = random.Random(1), [], []
    for i in range(400):
        words = [f"w{draw.randrange(3000)}" for _ in range(80)]
        kind = i % 8
        if kind == 0:
            words = [w + "###" for w in words]
        if kind == 1:
            words[5] = "vilewort"
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs += [(1000 + i, docs[2 + 8 * i][1], "en", "src1", 0) for i in range(10)] + [(2000, None, None, None, None), (2001, "few words", "en", "src1", 0)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs, labels = corpus(spark)
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    current, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, folder)
        if name != "packing":
            assert out.columns == docs.columns
            rows = out.collect()
            current = spark.createDataFrame(rows, docs.schema)
            seen.append(sorted(r.doc_id for r in rows))
        else:
            pieces = out.collect()
    clean = [i for i in range(400) if i % 8 > 1]
    copies = list(range(1000, 1010))
    assert seen[0] == sorted([i for i in range(400) if i % 8] + copies)
    assert seen[1] == sorted(clean + copies)
    texts = {r.doc_id: r.text for r in docs.collect()}
    label = {i: x[1] for i, x in brute([(i, texts[i]) for i in seen[1]]).items()}
    assert seen[2] == sorted(i for i in label if label[i] == i) == clean
    assert set(seen[3]) <= set(clean) and len(seen[3]) > 0.8 * len(clean)
    assert {p.doc_id for p in pieces} == set(seen[3])
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)
