"""Queries give every column their operators make."""

import datetime

from twinscan.plans.oracles import ORACLES
from twinscan.plans.queries import QUERIES
from twinscan.streaming.arrival_index import ArrivalIndex
from twinscan.streaming.incremental import compare_batch, read_pairs, with_copies


def pages(spark, folder):
    rows = [(i, f"https://{'ab'[i % 2]}.org/{p}", f"<!doctype html><h1>The page {i}</h1></html>") for i, p in enumerate(["en/1.html", "es/2.html", "fr/x/", "de/4"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_rule_queries_give_their_messages(spark, tmp_path):
    pages(spark, tmp_path)
    for name in ("rule_file_presence", "rule_directory_structure", "rule_file_content"):
        out = QUERIES[name](spark, str(tmp_path))
        assert "message" in out.columns and "AS message" in ORACLES[name]
        assert all(r.message for r in out.collect())


def test_pairs_of_the_stream_give_the_copies_behind_them(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    words = [f"w{i}" for i in range(20)]
    rows = [(str(i), "p", f"g{i}", "s", at + datetime.timedelta(hours=i), words if i < 3 else [*words[1:], "new"]) for i in range(5)]
    schema = "id string, project string, group_id string, step string, upload_time timestamp, parts array<string>"
    for name, ends in (("one", [5]), ("many", [1, 2, 4, 5])):
        for number, (a, b) in enumerate(zip([0, *ends], ends)):
            frame = spark.createDataFrame(rows[a:b], schema)
            compare_batch(frame, ArrivalIndex(spark, f"{tmp_path}/{name}", "r", number, 4), f"{tmp_path}/{name}-pairs", 0.7)
        found = with_copies(read_pairs(spark, f"{tmp_path}/{name}-pairs"), ArrivalIndex(spark, f"{tmp_path}/{name}", "reader", 0, 4))
        got = {(r.submission_id, r.compared_submission_id, r.copies) for r in found.collect()}
        assert got == {("1", "0", 3), ("2", "0", 3), ("3", "0", 3), ("4", "0", 3), ("4", "3", 2)}
