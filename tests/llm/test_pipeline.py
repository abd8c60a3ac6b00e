"""The corpus pipeline on a small folder: what each stage drops, cuts and keeps."""

from llm.helpers import prose

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    passage = " ".join(f"test{i}" for i in range(40))
    line = "\nthis very long licence line is found in a great many of the documents here"
    own = lambda i: "\n".join(f"{prose(100 * i + k, 12)} doc{i}x{k}" for k in range(9))
    texts = {i: own(i) for i in range(30)}
    texts |= {30: texts[2], 31: "12345 !!", 32: texts[3][:400] + " " + passage, 33: None}
    for i in range(5, 12):
        texts[i] += line
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, df = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        df = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r["doc_id"]: r.asDict() for r in df.collect()})
    assert set(kept[0]) == set(texts) - {31, 33}
    assert set(kept[1]) == set(kept[0])
    assert [i for i in range(5, 12) if line.strip() in kept[1][i]["text"]] == [11]
    assert all(kept[1][i]["n_chars"] == len(kept[1][i]["text"]) for i in kept[1])
    assert set(kept[2]) == set(kept[1]) - {30}
    assert set(kept[3]) == set(kept[2]) - {32}
    assert set(kept[4]) == set(kept[3])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
