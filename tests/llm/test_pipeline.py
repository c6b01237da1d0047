"""The pipeline's stages on tables of its own, and the queries' registration."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

PASSAGE = "This passage of many words stands in two documents and nowhere else, " + " ".join(f"word{i}" for i in range(80)) + "."


def write(spark, folder):
    clean = [(i, f"Clean text number {i} speaks of " + " ".join(f"thing{i}x{j}" for j in range(30))) for i in range(20)]
    rows = clean + [(100, "you are an idiot, a worthless clown"), (101, clean[3][1]), (102, clean[3][1] + " "), (103, " ".join(f"one{i}" for i in range(300)) + PASSAGE), (104, PASSAGE + " ".join(f"two{i}" for i in range(300))), (105, "mail me at bob@example.com now please, dear friend of mine"), (106, None), (107, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", -1 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i == 100)) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return dict(rows)


def test_stages_take_effect(spark, tmp_path):
    texts = write(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
    toxic, near, repeats, masked = kept
    assert set(texts) - set(toxic) == {100}
    assert set(toxic) - set(near) == {101, 102, 107}
    assert set(repeats) == set(near) and "word40" not in repeats[103] and "word40" not in repeats[104]
    assert all(repeats[i] == texts[i] for i in range(20))
    assert masked[105] == "mail me at <EMAIL> now please, dear friend of mine"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["length"] for r in packed} == wanted


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
