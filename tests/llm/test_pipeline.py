import corpus_pipeline
from reviewloom.llm import queries


def test_stages_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns, name
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "text_crc32", "size").collect())) == sorted(map(tuple, docs.select("doc_id", "text_crc32", "size").collect()))


def whole_pipeline(spark, folder, documents, labels=(), benchmark=()):
    """The pipeline's rows over tables of a folder, and each stage's."""
    tables = {
        "documents": spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, row long, node string, shard string, slot int, mix_doc long, best string"),
        "labels": spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(list(benchmark), "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(str(folder / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        kept[name] = docs
    return corpus_pipeline.run(spark, str(folder)), kept


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty, blank and very long texts, ties and columns of clashing names."""
    rest = (1, "n", "s", 2, 3, "b")
    near = " ".join(f"w{i}" for i in range(40))
    item = " ".join(f"bench{i}" for i in range(20))
    long = " ".join(f"v{i % 9973}" for i in range(200_000))
    texts = [(1, near), (2, near + " more"), (2, "another text under the same id with words"), (None, near), (None, None), (None, None), (3, ""), (4, " \n"), (5, long), (6, f"so {item} it is"), (7, "same words here now"), (7, "same words here now")]
    rows = [(i, t, "en", None if i == 5 else "a", 0, *rest) for i, t in texts]
    found, kept = whole_pipeline(spark, tmp_path, rows, benchmark=[(1, item), (2, None)])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert kept[names[0]].count() == len(rows)  # nothing is labelled, nothing goes
    stay = sorted((r["doc_id"] or 0, (r["text"] or "-")[:12]) for r in kept[names[1]].collect())
    assert stay == [(0, "-"), (0, "-"), (1, near[:12]), (2, "another text"), (3, "-"), (4, " \n"), (5, long[:12]), (6, "so bench0 be"), (7, "same words h")]
    assert sorted(r["doc_id"] or 0 for r in kept[names[2]].collect()) == [0, 0, 1, 2, 3, 4, 5, 7]
    mixed = kept[names[3]].collect()
    assert {r["doc_id"] for r in mixed} <= {1, 2, 5, 7} and all(tuple(r)[5:] == rest for r in mixed)
    assert all(kept[n].columns == kept[names[0]].columns for n in names[:4])
    shards = found.collect()
    assert len(shards) == len(mixed) and {r["doc_id"] for r in shards} == {r["doc_id"] for r in mixed}
    slots = {}
    for r in shards:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_pipeline_over_empty_tables(spark, tmp_path):
    found, kept = whole_pipeline(spark, tmp_path, [])
    assert found.count() == 0 and all(k.count() == 0 for k in kept.values())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
