import pytest
from pyspark.sql import functions as F

from concord.functions import names, typerules
from concord.sources import catalog


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s"))).first()[0]


@pytest.mark.parametrize("raw, expected", [
    ("NhaCungCap", "nha cung cap"), ("Mã nhân viên", "ma nhan vien"), ("Đẹp trai", "ep trai"),
    ("SốHóaĐơn", "sohoa on"), ("c_custkey", "c custkey"), ("  A--b\u00a0c ", "a b c"), ("e\u0301t\u00e9", "ete"), ("", ""),
])
def test_normalize(spark, raw, expected):
    assert one(spark, raw, names.normalize) == expected


@pytest.mark.parametrize("raw, expected", [("ChiTien", "tra tien"), ("manv", "manhanvien"), ("CT", "chi tiet"), ("orders", "orders")])
def test_canonical(spark, raw, expected):
    assert one(spark, raw, names.canonical) == expected


def test_canonical_tokens(spark):
    fix = lambda c: names.canonical_tokens(c, {"nv": "nhan vien"}, {"ma nhan vien": "employee id", "id": "key"})
    assert one(spark, "MaNv", fix) == "employee key"


@pytest.mark.parametrize("raw, strict, compat, plain", [
    ("08.CT_ChiTien", "CT_CHITIEN", "T_CHITIEN", "CT_CHITIEN"), ("07.ChiTien", "CHITIEN", "HITIEN", "CHITIEN"),
    ("07. CHITIEN", "CHITIEN", "HITIEN", "CHITIEN"), ("DM_Kho", "KHO", "KHO", "DM_KHO"), ("NhanVien", "NHANVIEN", "NHANVIEN", "NHANVIEN"),
])
def test_clean_table(spark, raw, strict, compat, plain):
    assert one(spark, raw, names.clean_table) == strict
    assert one(spark, raw, lambda c: names.clean_table(c, compat=True)) == compat
    assert one(spark, raw, names.clean_table_plain) == plain


@pytest.mark.parametrize("raw, expected", [("NhaCungCap", "NCC"), ("HangHoa", "HH"), ("kho", "K"), ("", "")])
def test_acronym(spark, raw, expected):
    assert one(spark, raw, names.acronym) == expected


@pytest.mark.parametrize("path, expected", [
    ("dapan.bak", "00000001"), ("C:\\in\\x_12345678.bak", "12345678"), ("/in/abc.bak", "abc"), ("v1.2_x.bak", "v1.2_x"),
])
def test_submission_id(spark, path, expected):
    assert one(spark, path, names.submission_id) == expected


def test_fk_names(spark):
    assert one(spark, "07. HoaDon_12", names.clean_fk_table) == "HoaDon"
    assert one(spark, "MaHD_3", names.clean_fk_column) == "MaHD"
    assert one(spark, "FK_HD_12.KH_3", names.clean_constraint) == "FK_HD_KH"


@pytest.mark.parametrize("a, ta, b, tb, either, loose", [
    ("MaNV", "int", "MaNV", "varchar", True, False), ("Ten", "varchar", "Ten", "nvarchar", True, True),
    ("SoLuong", "int", "SoLuong", "decimal(12,2)", False, True), ("Ngay", "date", "Ngay", "datetime", True, True),
    ("MaNV", "int", "Ten", "varchar", True, False),
])
def test_types(spark, a, ta, b, tb, either, loose):
    row = spark.createDataFrame([(a, ta, b, tb)], "a string, ta string, b string, tb string").select(
        typerules.same_type("ta", "tb", "a", "b").alias("e"), typerules.same_type("ta", "tb", "a", "b", "both").alias("o"),
        typerules.loose_type("ta", "tb").alias("l")).first()
    assert (row.e, row.l) == (either, loose)
    if a == "MaNV" and b == "Ten":
        assert row.o is False


def test_stage_filter(spark):
    raw = spark.createDataFrame(
        [("1", t, 1, "x", "int") for t in ("StageOrders", "01.HangTonKho", "sysdiagrams", "MyStage")],
        "submission_id string, original_name string, ordinal int, column_name string, data_type string")
    assert [r.cleaned_name for r in catalog.prepare_columns(raw).collect()] == ["HANGTONKHO"]
    kept = catalog.prepare_columns(raw, stage_prefix_only=True)
    assert sorted(r.cleaned_name for r in kept.collect()) == ["HANGTONKHO", "MYSTAGE"]


def test_fk_info_skips_empty_fields(spark):
    info = spark.createDataFrame(
        [("1", "f", "A", "B", "x,y", "u,v"), ("1", "g", "A", None, "x", "u"), ("1", "h", "A", "B", "", "u")],
        "submission_id string, fk_name string, parent_table string, ref_table string, fk_columns string, pk_columns string")
    rows = catalog.read_fk_info(info).collect()
    assert [(r.fk_name, r.parent_cols, r.ref_cols) for r in rows] == [("f", ["x", "y"], ["u", "v"])]


def test_composite_keys_keep_their_order(spark):
    flat = spark.createDataFrame(
        [("1", "f", "A", "z", "B", "p", 1), ("1", "f", "A", "a", "B", "q", 2)],
        "submission_id string, fk_name string, parent_table string, fk_column string, ref_table string, pk_column string, ordinal int")
    row = catalog.fold_fks(flat).first()
    assert (row.parent_cols, row.ref_cols) == (["z", "a"], ["p", "q"])
    assert catalog.fk_info(flat).first().fk_columns == "z,a"


def test_name_collisions_are_reported(spark):
    cols = spark.createDataFrame(
        [("1", "01. Kho", "KHO", 1, "a", "int"), ("1", "Kho", "KHO", 1, "b", "int")],
        "submission_id string, original_name string, cleaned_name string, ordinal int, column_name string, data_type string")
    row = catalog.fold_schema(cols).first()
    assert row.collision and row.original_name == "01. Kho" and [c.name for c in row.cols] == ["a", "b"]
