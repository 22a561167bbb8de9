import pytest

from fieldloom.llm import warc

PAGES = "page_id long, url string, html string"


def test_long_urls_keep_their_file(spark, tmp_path):
    rows = [(i, "http://a/" + "u" * (70_000 if i == 2 else 9), f"page {i}") for i in range(6)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == rows


def test_a_broken_chain_is_an_error(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "abc"), (2, "u", "def")], PAGES).coalesce(1), str(tmp_path / "w"))
    whole = next((tmp_path / "w").rglob("*.txt")).read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.txt").write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="records end at byte"):
        warc.read_archives(spark, str(tmp_path / "cut"))
