from __future__ import annotations

import os
import stat

import pytest

from sablecloth.errors import LimitError, LineError
from sablecloth.plans.policy import Policy
from sablecloth.sources import files


def test_lines_are_numbered_across_splits(spark, tmp_path):
    ends = ["\n", "\r\n"]
    texts = [f"line {i} " + "x" * (i * 37 % 300) for i in range(1, 3001)]
    (tmp_path / "a.log").write_bytes("".join(x + ends[i % 2] for i, x in enumerate(texts)).encode())
    (tmp_path / "b.log").write_bytes(b"only\r\n\r\nlast without an end")
    (tmp_path / "c.log").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.text_lines(spark, str(tmp_path))
        got = sorted((r.path.rsplit("/", 1)[-1], r.line_number, r.text) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [("a.log", i, x) for i, x in enumerate(texts, 1)] + [("b.log", 1, "only"), ("b.log", 2, ""), ("b.log", 3, "last without an end")]


def test_audit_names_what_was_not_seen(spark, tmp_path):
    (tmp_path / "a.log").write_text("mail a@b.co\n" + "x" * (files.MAX_LINE + 1) + "\nmail a@b.co\n")
    (tmp_path / "b.log").write_text("nothing\n")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.audit_text(spark, str(tmp_path)).collect()}
    assert (rows["a.log"].lines, rows["a.log"].finding_count, rows["a.log"].complete, rows["a.log"].limitations) == (3, 2, False, ["max_line_chars"])
    assert (rows["b.log"].finding_count, rows["b.log"].complete, rows["b.log"].limitations) == (0, True, [])
    import dataclasses

    one = dataclasses.replace(Policy(), max_findings=1)
    assert {r.finding_count: r.limitations for r in files.audit_text(spark, str(tmp_path / "a.log"), one).collect()} == {1: ["max_line_chars", "max_findings"]}


def test_frames_keep_line_ends(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"a@b.co\r\nplain\n")
    files.clean_text_files(spark, str(tmp_path / "a.log"), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == b"[EMAIL]\r\nplain\n"


def test_a_file_keeps_its_encoding_and_mode(tmp_path):
    source, out = tmp_path / "s.log", tmp_path / "o.log"
    source.write_bytes("é a@b.co\r\nb".encode("utf-16"))
    source.chmod(0o600)
    files.clean_file(source, out, encoding="utf-16")
    assert out.read_bytes().decode("utf-16") == "é [EMAIL]\r\nb"
    assert stat.S_IMODE(out.stat().st_mode) == 0o600
    out.chmod(0o640)
    files.clean_file(source, out, encoding="utf-16")
    assert stat.S_IMODE(out.stat().st_mode) == 0o640


def test_links(tmp_path):
    source, target, link, alias = (tmp_path / n for n in ("s.log", "t.log", "l.log", "h.log"))
    source.write_text("a@b.co\n")
    target.write_text("old\n")
    link.symlink_to(target)
    assert files.clean_file(source, link) == link
    assert link.is_symlink() and target.read_text() == "[EMAIL]\n"
    os.link(source, alias)
    with pytest.raises(ValueError, match="hard-link"):
        files.clean_file(source, alias)
    assert alias.read_text() == source.read_text() == "a@b.co\n"
    alias.unlink()
    files.clean_file(source, source)
    assert source.read_text() == "[EMAIL]\n"


def test_outputs_that_cannot_be(tmp_path):
    source = tmp_path / "s.log"
    source.write_text("x" * (files.MAX_LINE + 1))
    for out, error in ((tmp_path, IsADirectoryError), (tmp_path / "no" / "o.log", FileNotFoundError), (source / "o.log", NotADirectoryError)):
        with pytest.raises(error):
            files.clean_file(source, out)
    with pytest.raises(FileNotFoundError):
        files.clean_file(tmp_path / "none", tmp_path / "o.log")
    with pytest.raises(LimitError):
        files.clean_file(source, tmp_path / "o.log")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.log"]


def test_scans_of_json_lines_name_bad_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'{"m": "a@b.co"}\n{bad\n\n\xff\n{"m": "x"}\n')
    lines = files.jsonl_lines(spark, str(path))
    assert [(r.line_number, r.error, r.complete) for r in files.scanned_jsonl(lines, on_error="placeholder").orderBy("line_number").collect()] == [(1, None, True), (2, "invalid_json", False), (4, "invalid_utf8", False)]
    assert [r.line_number for r in files.scanned_jsonl(lines).collect()] == [1]
    with pytest.raises(Exception, match="invalid_json|line 2"):
        files.scanned_jsonl(lines, on_error="raise").collect()
    assert issubclass(LineError, Exception)


def test_everything_public_is_there():
    import sablecloth

    assert len(set(sablecloth.__all__)) == len(sablecloth.__all__) and all(hasattr(sablecloth, n) for n in sablecloth.__all__)


def test_functions_of_urls_and_json_in_sql(spark):
    from sablecloth.functions.sql import register
    from sablecloth.operators.urls import clean_url

    register(spark, Policy())
    url = "https://h.example/p?token=abc123456789"
    got = spark.sql(f"""SELECT clean_url('{url}') u, clean_url(cast(null AS string)) n, clean_json_text('{{"m": "a@b.co"}}') j, clean_json_text('no') b""").first()
    assert (got.u, got.n, got.j, got.b) == (clean_url(url), None, '{"m": "[EMAIL]"}', '{"_error": "invalid_json"}')
