"""The pipeline's stages, and the registered queries of the subpackage, on the smallest tables."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import packing, queries
from linkloom.llm.encode import encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame(
        [(90_001, None), (90_002, ""), (90_003, "x" * 100_000), (None, "no id at all, but a text"), (90_004, "twice the same row"), (90_004, "twice the same row")],
        "doc_id long, text string",
    )
    docs = docs.unionByName(extra, allowMissingColumns=True)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    poor = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("toxic = 0 AND quality = 1").collect()}
    kept = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    before = set(ids["documents"])
    assert len(set(ids["toxicity"]) & toxic) <= 0.5 * len(before & toxic)
    assert len(set(ids["toxicity"]) & good) == len(before & good)
    after = set(ids["quality"])
    assert len(after & poor) < 0.5 * len(set(ids["toxicity"]) & poor)
    assert len(after & good) >= 0.95 * len(set(ids["toxicity"]) & good)
    # near duplicates, by comparing all pairs
    rows = [r for r in kept["quality"] if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if group[a] < group[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[b] = group[a]
                    changed = True
                elif group[a] < group[b] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[b] = group[a]
    want = sorted(i for i, g in group.items() if i == g)
    assert sorted(i for i in ids["near_duplicates"] if i is not None) == want
    assert ids["near_duplicates"].count(None) == ids["quality"].count(None)
    # leaks: whole benchmark texts
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in kept["near_duplicates"]:
        text = " ".join(re.findall(r"\w+", (r.text or "").lower()))
        if any(item in text for item in items):
            assert r.doc_id not in ids["decontamination"]
    assert set(ids["decontamination"]) >= {
        r.doc_id for r in kept["near_duplicates"] if not any(set(i.split()) & set(re.findall(r"\w+", (r.text or "").lower())) for i in items)
    }
    # packing: every document left, whole
    encode = encoder(packing.TOKENIZER, False).tokenizer.encode
    total = {r.doc_id: len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept["decontamination"]}
    got = {}
    for r in kept["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_and_tied_rows(spark):
    from linkloom.llm import partenum

    rows = [(1, "b c d e f g", 1), (1, "a c d e f g", 2), (2, "a c d e f g", 3), (3, "z", 4), (3, "z", 5), (None, "z", 6), (None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    got = partenum.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None", "None"]


def test_run_leaves_only_its_result(spark):
    from linkloom.session import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    new = set(folder.iterdir()) - before
    assert len(new) == 1 and [p.name for p in next(iter(new)).iterdir()] == ["packing"]


def test_url_filter_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = connection.execute(queries.ORACLES["op8_url_filter"]).fetchall()
    got = queries.QUERIES["op8_url_filter"](spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


CONTRACTS = {
    "op1_best_fit_packing": ("documents", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    "op2_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op3_token_files": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op4_token_counts": ("documents", ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens"]),
    "op5_chat_windows": ("conversations", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]),
    "op6_jaccard_join": ("documents", ["doc_id", "n_shingles", "component_id"]),
    "op7_merkle_fingerprints": (
        "documents", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    ),
    "op8_url_filter": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op9_quality": ("documents", ["doc_id", "evidence", "score", "keep"]),
    "op10_decontamination": ("documents", ["doc_id", "item_id", "doc_word", "matched", "item_words", "densest"]),
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_and_rows(spark, name):
    table, columns = CONTRACTS[name]
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == columns
    key = F.col(columns[0])
    ids = {r[0] for r in got.select(key).distinct().collect()}
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    want = {r[0] for r in source.select(key).distinct().collect()} | ({-1} if table == "conversations" else set())
    assert ids <= want if name == "op10_decontamination" else ids == want
