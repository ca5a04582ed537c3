"""The pipeline, stage by stage, against brute force."""

import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import tiktoken

from contrail.llm import bpe, simhash
from test_decontaminate import slow as slow_hits
from test_pii import slow as slow_pii
from test_simhash import slow_classes, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = documents.collect()

    kept = cp.drop_toxic(spark, documents, FOLDER).collect()
    left = {r.doc_id for r in kept}
    assert set(kept) <= set(rows)
    clean = [d for d, toxic in labels.items() if toxic == 0]
    assert sum(d in left for d in clean) >= 0.95 * len(clean)

    kept = cp.drop_near_copies(spark, documents, FOLDER).collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    roots, least = slow_classes(prints.values()), {}
    for doc, code in prints.items():
        least[roots[code]] = min(doc, least.get(roots[code], doc))
    assert sorted(kept) == sorted(r for r in rows if r.doc_id in set(least.values()))

    kept = cp.drop_contaminated(spark, documents, FOLDER).collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {r.doc_id for r in kept}
    assert set(kept) <= set(rows) and len(kept) < len(rows)
    for row in sorted(rows)[:12]:
        n_words, n_hit, _ = slow_hits(bench, row.text)
        assert (row.doc_id in left) == (n_hit == 0 or 20 * n_hit < n_words)

    kept = {r.doc_id: r for r in cp.mask_personal_data(spark, documents, FOLDER).collect()}
    assert len(kept) == len(rows)
    for row in rows:
        found = slow_pii(row.text)
        if not found:
            assert kept[row.doc_id] == row
        else:
            assert kept[row.doc_id].n_chars == len(kept[row.doc_id].text)
            assert all(row.text[a:b] not in kept[row.doc_id].text for _, a, b in found)

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = bpe.Vocabulary(file.read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in rows}
    for row in cp.tokenise(spark, documents, FOLDER).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert np.frombuffer(row.token_ids, "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_toxic_documents_go(spark):
    folder = FOLDER.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    left = {r.doc_id for r in cp.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    toxic = [r.doc_id for r in labels if r.toxic]
    assert sum(d not in left for d in toxic) >= 0.7 * len(toxic)
    assert all(r.doc_id in left for r in labels if r.toxic == 0)


def test_run_applies_all_stages(spark):
    found = cp.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))
    assert 0 < found.count() < 200


def test_odd_documents(spark, tmp_path):
    rows = [(1, "A good text about things.", "en", "s", 25), (1, "A good text about things.", "en", "s", 25), (1, "Another text, same id, quite different.", None, None, None),
            (2, None, "en", "s", None), (3, "", "en", None, 0), (None, "A good text about things.", "en", "s", 25), (None, "No id but mail a@b.cd and more", "en", "s", 30),
            (None, "No id but mail a@b.cd and more", "en", "s", 30), (7, "long " * 50_000, "en", "s", 250_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hits int, score double, fp string, toxicity int, masked int, _kept_id int, _kept_th int"
    docs = spark.createDataFrame([(*row, 1, 0.5, "x", 2, 3, 4, 5) for row in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.filter("hits <> 1 OR fp <> 'x' OR toxicity <> 2").count() == 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = simhash.representatives(docs).collect()
    wanted = {(1, rows[0][1]), (1, rows[2][1]), (2, None), (7, rows[8][1]), (None, rows[6][1])}
    assert {(r.doc_id, r.text) for r in kept} == wanted
    assert len(kept) == 5
    assert cp.run(spark, str(tmp_path)).count() == 5
