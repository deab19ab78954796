from harrow import cli


def test_run_over_tables(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "c.csv").write_text("Company\nAlpha GmbH\n\nNobody\n")
    spark.createDataFrame([("Alpha GmbH", 1, "https://alpha.de/")], "company string, rank int, link string").write.parquet(str(tmp_path / "s"))
    page = ("https://alpha.de", 200, "text/html", "<p>write office@alpha.de now</p>", None)
    spark.createDataFrame([page], "url string, status int, content_type string, text string, rendered_html string").write.parquet(str(tmp_path / "r"))
    args = [str(tmp_path / "c.csv"), str(tmp_path / "o"), "--search", str(tmp_path / "s"), "--responses", str(tmp_path / "r")]
    assert cli.main(args) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("Alpha GmbH", "alpha.de", "office@alpha.de")]
    out = capsys.readouterr().out
    assert "with_email" in out and "n_emails" in out
    (tmp_path / "bad.csv").write_text("Name\nx\n")
    assert cli.main([str(tmp_path / "bad.csv"), *args[1:]]) == 1


def test_settings_file_and_suffixes(spark, tmp_path, monkeypatch, capsys):
    from harrow.config import Options, read_settings

    (tmp_path / "s.env").write_text("# a remark\nexport MAX_FALLBACK_PAGES=7\nBLOCKED_DOMAINS='alpha.de, b.de'\n\nno sign\n")
    assert read_settings(str(tmp_path / "s.env")) == {"MAX_FALLBACK_PAGES": "7", "BLOCKED_DOMAINS": "alpha.de, b.de"}
    assert Options.from_env(read_settings(str(tmp_path / "s.env")))["MAX_FALLBACK_PAGES"] == 7
    (tmp_path / "c.csv").write_text("Company\nAlpha GmbH\n")
    hit = ("Alpha GmbH", 1, "https://alpha.k12.ca.us/")
    spark.createDataFrame([hit], "company string, rank int, link string").write.parquet(str(tmp_path / "s"))
    pages = [(f"https://{h}", 200, "text/html", f"<p>write office@{h} now</p>", None) for h in ("alpha.k12.ca.us", "alpha.de")]
    spark.createDataFrame(pages, "url string, status int, content_type string, text string, rendered_html string").write.parquet(str(tmp_path / "r"))
    args = [str(tmp_path / "c.csv"), str(tmp_path / "o"), "--search", str(tmp_path / "s"), "--responses", str(tmp_path / "r")]
    assert cli.main([*args, "--suffixes", "bundled", "--config", str(tmp_path / "s.env")]) == 0
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("Alpha GmbH", "alpha.k12.ca.us", "office@alpha.k12.ca.us")]
    assert cli.main([*args, "--config", str(tmp_path / "none.env")]) == 1
    capsys.readouterr()


def test_cache_as_json(spark, tmp_path):
    from harrow.operators import cache
    from harrow.sources import readers

    rows = [("k", "v", 1.0), ("gone", None, 2.0)]
    for name in ("c.json", "c"):
        cache.write(spark.createDataFrame(rows, "key string, value string, ts double"), str(tmp_path / name))
        assert sorted(map(tuple, readers.cache(spark, str(tmp_path / name)).collect())) == sorted(rows)
