import corpus_pipeline as P
from nearfold.llm import mixing, packing, tjoin, toxicity

from .helpers import SF, clashing, groups, odd_documents


def test_run_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.selectExpr("doc_id", "toxic AS label").where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"))
    clean = toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)
    kept = {r[0] for r in groups([(r["doc_id"], r["text"]) for r in clean.collect()]) if r[0] == r[2]}
    left = clean.where(clean["doc_id"].isin(sorted(kept)))
    copies = {}
    for r in mixing.replicate(left).select("doc_id").collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    n_tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(left).collect()}
    got = P.run(spark, SF).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {d: c * n_tokens[d] for d, c in copies.items()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "mixing", "packing"] and P.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    docs = clashing(odd_documents(spark, spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.columns == docs.columns and out.where("score <> 'clash' OR predicted <> 'clash' OR copies <> 'clash' OR rate <> 'clash'").isEmpty()
            path = f"{tmp_path}/{name}-{start.count()}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
        assert P.STAGES[-1][1](spark, now, SF).count() >= now.count()
    once = P.drop_near_duplicates(spark, docs, SF)
    assert once.where("doc_id = 5 AND text = 'dup id'").count() == 1 and once.where("doc_id IS NULL").count() == 2
    assert once.where("doc_id IN (2003, 2004)").count() == 1 and once.where("doc_id IN (2000, 2001, 2002)").count() == 3


def test_each_text_of_a_repeated_id_has_its_own_group(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (7, y + " more"), (20, z), (21, z + " end"), (21, x + " last"), (21, "alone with words of its own"), (30, "a b c d e f g"), (30, "A  b c d e f g"), (30, ""), (30, ""), (30, None), (None, x), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in tjoin.join(docs).where("doc_id IN (5, 21)").collect()) == [(5, 3), (5, 5), (21, 3), (21, 20), (21, 21)]
    got = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    want = [(3, x), (5, y), (20, z), (21, "alone with words of its own"), (30, "A  b c d e f g"), (30, ""), (30, None), (None, x), (None, x)]
    assert got == sorted(want, key=str)
