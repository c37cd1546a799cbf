import os

import pytest

from ledgerloom.functions.constants import MAX_FILE_BYTES
from ledgerloom.sources.admission import file_admission
from ledgerloom.sources.files import ROW_ID, read_file


def _write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_utf8_and_latin1_csv(spark, tmpdir_path):
    u = _write(tmpdir_path, "u.csv", "name,city\nJosé,Zürich\nNA,x\n".encode("utf-8"))
    l1 = _write(tmpdir_path, "l.csv", "name,city\nJosé,Zürich\n".encode("latin-1"))
    du = read_file(spark, u).orderBy(ROW_ID).collect()
    assert du[0].name == "José" and du[0].city == "Zürich" and du[1].name is None
    dl = read_file(spark, l1).collect()
    assert dl[0].name == "José" and dl[0].city == "Zürich"


def test_txt_tab_then_comma(spark, tmpdir_path):
    tab = _write(tmpdir_path, "t.txt", b"a\tb\n1\t2\n")
    comma = _write(tmpdir_path, "c.txt", b"a,b\n1,2\n")
    assert read_file(spark, tab).columns[:2] == ["a", "b"]
    assert read_file(spark, comma).columns[:2] == ["a", "b"]


def test_unsupported_extensions(spark, tmpdir_path):
    with pytest.raises(ValueError, match="Unsupported file extension"):
        read_file(spark, _write(tmpdir_path, "x.json", b"{}"))
    with pytest.raises(ValueError, match="xls"):
        read_file(spark, _write(tmpdir_path, "x.xls", b"\xd0\xcf\x11\xe0"))


def test_admission(spark, tmpdir_path):
    _write(tmpdir_path, "ok.csv", b"a,b\n1,2\n")
    _write(tmpdir_path, "OK2.TXT", b"a\tb\n")
    _write(tmpdir_path, "book.xlsx", b"PK\x03\x04rest")
    _write(tmpdir_path, "bin.csv", b"\x00\x01\x02\xff\xfe")
    _write(tmpdir_path, "big.csv", b"x" * 101)
    _write(tmpdir_path, "pic.png", b"\x89PNG")
    rows = {r.file_name: r for r in file_admission(spark, tmpdir_path, max_bytes=100).collect()}
    assert rows["ok.csv"].accepted and rows["OK2.TXT"].accepted and rows["book.xlsx"].accepted
    assert rows["bin.csv"].reason == "Invalid file content. File may be corrupted."
    assert rows["big.csv"].reason.startswith("File too large. Max size: ")
    assert rows["pic.png"].reason == "File type not allowed. Allowed: .csv, .xlsx, .xls, .txt"
    full = {r.file_name: r for r in file_admission(spark, tmpdir_path).collect()}
    assert full["big.csv"].accepted and full["big.csv"].size_mb == 101 / 1024 / 1024
    assert MAX_FILE_BYTES == 50 * 1024 * 1024


def test_materialized_read_detects_encoding_in_one_scan(spark, tmpdir_path):
    from ledgerloom.sources.files import read_csv

    _write(tmpdir_path, "u.csv", "name,city\nJosé,Zürich\n".encode("utf-8"))
    _write(tmpdir_path, "l.csv", "name,city\nJoão,Málaga\n".encode("latin-1"))
    rows = {tuple(r) for r in read_csv(spark, tmpdir_path, materialize=True).collect()}
    assert rows == {("João", "Málaga"), ("José", "Zürich")}
    comma = _write(tmpdir_path, "c.txt", b"a,b\n1,2\n")
    assert read_file(spark, comma, materialize=True).columns[:2] == ["a", "b"]


def test_quotes_breaks_and_short_rows(spark, tmpdir_path):
    p = _write(tmpdir_path, "q.csv", b'Date,date,x\n1,2,"12"" pipe, steel"\n3,4\n5,6,"two\nlines"\n')
    df = read_file(spark, p, materialize=True)
    assert df.columns[:3] == ["Date", "date_1", "x"]
    assert [tuple(r)[:3] for r in df.orderBy(ROW_ID).collect()] == [
        ("1", "2", '12" pipe, steel'), ("3", "4", None), ("5", "6", "two\nlines")]


def test_a_row_too_long_is_an_error_not_a_cut(spark, tmpdir_path):
    p = _write(tmpdir_path, "long.csv", b'a,b\n1,2\n1,"x,y",3\n')
    with pytest.raises(Exception, match="more than the header's 2 cells"):
        read_file(spark, p).collect()
    ok = _write(tmpdir_path, "ok.csv", b'a,b\n1,"x,y"\n')
    assert read_file(spark, ok).collect()[0].b == "x,y"


def test_files_are_matched_by_name(spark, tmpdir_path):
    from ledgerloom.sources.files import read_csv

    _write(tmpdir_path, "1.csv", b"date,qty\n2024-01-01,3\n")
    _write(tmpdir_path, "2.csv", b"qty,date,note\n4,2024-01-02,n\n")
    rows = {(r.date, r.qty, r.note) for r in read_csv(spark, tmpdir_path).collect()}
    assert rows == {("2024-01-01", "3", None), ("2024-01-02", "4", "n")}


def test_replacement_character_in_valid_utf8_stays(spark, tmpdir_path):
    p = _write(tmpdir_path, "r.csv", "n,c\nJos\u00e9 \ufffd,x\n".encode())
    assert read_file(spark, p).collect()[0].n == "Jos\u00e9 \ufffd"


def test_repeated_headers(spark):
    from ledgerloom.sources.files import header_names

    assert header_names(["a", "a", "A", "", "b"]) == ["a", "a.1", "A_1", "Unnamed: 3", "b"]
