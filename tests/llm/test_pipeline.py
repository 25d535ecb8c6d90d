from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from symloom.llm.pieces import codec
from symloom.llm.queries import vocabulary


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"


def _tables(spark, folder, docs, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", False) for i, t in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(17)
    lexicon = ["".join(rng.choice(["ta", "ke", "mi", "so", "ru"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    say = lambda: " ".join(rng.choice(lexicon) for _ in range(60))
    texts = [say() for _ in range(80)]
    item = " ".join(rng.choice(lexicon) for _ in range(20))
    near = texts[3].split()
    near[30] = "kemiso"
    nameless, other, leak = say(), say(), say() + " " + item
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(200, texts[0] + " "), (201, " ".join(near)), (202, texts[5] + " " + item), (203, "#$%&*" * 60), (204, None), (205, ""), (7, texts[7])]
    # without an id: a copy, a clean text twice, noise, a leak; an id that two texts share
    rows += [(None, texts[9]), (None, nameless), (None, nameless), (None, "#$%&*" * 60), (None, leak), (None, None), (8, other)]
    _tables(spark, tmp_path, rows, [(k, 1, 0) for k in range(60)], [(1, item)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ours = codec(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    # 200 stays in place of 0: it has more characters; 201 is near 3, 202 leaks, 203 is noise
    want = [(k, texts[k]) for k in range(1, 80)] + [(200, texts[0] + " "), (None, nameless), (8, other)]
    assert sorted(((str(r.doc_id), ours.decode(r.ids).strip()) for r in got)) == sorted((str(i), t.strip()) for i, t in want)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]


def test_stages_of_empty_tables_keep_the_columns(spark, tmp_path):
    docs = [(1, "ta ke mi so ru"), (None, "other words in a text of seven"), (2, "")]
    _tables(spark, tmp_path, docs, [], [])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["1", "None"]
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and out.columns == none.columns
