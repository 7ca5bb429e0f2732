import sys
import types

import pytest

from textinsight.__main__ import main


@pytest.fixture
def client_path(monkeypatch):
    def make_client():
        def client(messages, temperature):
            return '{"title": "T", "insight": "I", "actions": ["a"]}'

        return client

    make_client.__module__ = "__main__"  # travels to the workers by value
    module = types.ModuleType("stand_in_model")
    module.make_client = make_client
    monkeypatch.setitem(sys.modules, "stand_in_model", module)
    return "stand_in_model:make_client"


def test_survey_job_on_lines(spark, tmp_path, client_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "answers.txt").write_text("lower the fee\nfee too high\n\nmore webinars\nEND\nignored\n")
    main(["survey", "--input", str(tmp_path / "in"), "--format", "lines", "--name", "S", "--question", "Q?",
          "--clusters", "2", "--client", client_path, "--output", str(tmp_path / "out")])
    rows = spark.read.parquet(str(tmp_path / "out/clustered")).orderBy("response_id").collect()
    assert [row["response"] for row in rows] == ["lower the fee", "fee too high", "more webinars"]
    text = "\n".join(row["value"] for row in spark.read.text(str(tmp_path / "out/report")).collect())
    assert "Cluster 0 - T" in text and "Top Keywords: " in text


def test_sites_job(spark, tmp_path, client_path):
    spark.createDataFrame(
        [(0, "http://a.example/", "<body>x</body>"), (1, "http://b.example/", "<body>y</body>")],
        "page_id long, url string, html string",
    ).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([(1, "http://a.example/", "http://b.example/")], "pair_id long, seed_a string, seed_b string").write.parquet(
        str(tmp_path / "pairs"))
    main(["sites", "--pages", str(tmp_path / "pages"), "--pairs", str(tmp_path / "pairs"), "--client", client_path,
          "--output", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 5
