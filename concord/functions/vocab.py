"""Word lists and constants that results depend on."""

ANSWER_ID = "00000001"

# Whole-name aliases of tables and columns.
NAME_ALIASES = {
    "chitien": "tratien",
    "ct_chitien": "ct_tratien",
    "chitietchitien": "chitiettratien",
    "pmh": "phieumuahang",
    "manv": "manhanvien",
    "sohd": "sohoadon",
}

# Whole-name synonyms.
NAME_SYNONYMS = {
    "chi": "tra",
    "chi tien": "tra tien",
    "phieu chi": "phieu tra tien",
    "chitiet": "chi tiet",
    "ct": "chi tiet",
    "chitietchitien": "chitiettratien",
    "ct_chitien": "chitiettratien",
    "cttratien": "chitiettratien",
    "cttt": "chitiettratien",
    "chitien": "tratien",
    "phieuchi": "phieutratien",
    "phieunhap": "phieumuahang",
    "tra": "tra",
    "tratien": "tratien",
    "chitiettratien": "chitiettratien",
    "phieutratien": "phieutratien",
}

# Phrases of the accounting domain and their equivalents.
DOMAIN_PATTERNS = {
    "chi tien": ["tra tien", "thanh toan", "payment"],
    "mua hang": ["nhap hang", "purchase", "buying"],
    "chi tiet chi tien": ["chi tiet tra tien", "ct tra tien", "payment details"],
    "chi tiet mua hang": ["chi tiet nhap hang", "ct mua hang", "purchase details"],
    "nha cung cap": ["ncc", "supplier", "vendor"],
    "nhan vien": ["staff", "employee", "personnel"],
    "hang hoa": ["mat hang", "san pham", "item", "product"],
    "loai tien": ["tien te", "currency", "money type"],
    "kho": ["hang ton kho", "warehouse", "inventory"],
}

# The frame around a domain-expanded text.
DOMAIN_INTRO = "Trong ngữ cảnh kế toán và quản lý tài chính:"
DOMAIN_OUTRO = "Các khái niệm tương đương:"

# Words that mark a column as a code when it starts or ends with one.
CODE_WORDS = ("ma", "code", "id", "sohieu", "phieu", "voucher")

# The earlier list of such words.
CODE_WORDS_EARLY = ("ma", "code", "id", "sohieu", "voucherid")

# Type families; the second group are Spark's own names.
TYPE_FAMILY = {
    "char": "str", "varchar": "str", "nvarchar": "str", "nchar": "str",
    "int": "int", "bigint": "int", "smallint": "int",
    "decimal": "num", "numeric": "num", "money": "num", "real": "num", "float": "num",
    "date": "dt", "datetime": "dt", "smalldatetime": "dt",
    "string": "str", "tinyint": "int", "double": "num",
    "timestamp": "dt", "timestamp_ntz": "dt",
}

# Words whose presence in both names lifts an uncertain column score.
SHARED_WORDS = ("id", "name", "date", "time", "code", "number", "amount")

# Expected row increases of the accounting assignment.
EXPECTED_DELTA = {
    "NhaCungCap": 1,
    "NhanVien": 1,
    "HangHoa": 1,
    "MuaHang": 1,
    "ChiTietMuaHang": 1,
}

# Marks per ratio (columns, foreign keys, data, views, business) and the ceiling.
MARKS = {"column": 3, "fk": 2, "data": 1, "view": 3, "business": 1}
MARK_CEILING = 10.0

# Decision thresholds.
TABLE_MIN_COSINE = 0.5
TABLE_LEGACY_COSINE = 0.80
COLUMN_MIN_SCORE = 0.75
COLUMN_LEGACY_SCORE = 0.82
UNCERTAIN_LOW, UNCERTAIN_HIGH = 0.5, 0.8
FK_MIN_SIMILARITY = 0.85
FUZZY_MIN = 80
SMART_MIN = 70
TABLE_TEXT_COLUMNS = 30
TABLE_TEXT_FKS = 10
SCORE_PER_TABLE = 0.5
ENOUGH_COLUMNS = 0.80
EXPECTED_VIEWS = 3

# Words of the reports.
YES = "Có"
NO = "Không"
STATUS_ERROR = "Lỗi"
STATUS_BUSINESS = "Đúng nghiệp vụ"
STATUS_DATA = "Khớp dữ liệu"
STATUS_BUSINESS_WRONG = "Sai nghiệp vụ"
STATUS_DATA_WRONG = "Sai lệch dữ liệu"
NOTE_BUSINESS = "Dữ liệu và nghiệp vụ đều đúng."
NOTE_DATA = "Số dòng khớp chính xác."
NOTE_BUSINESS_WRONG = "Chênh lệch %d, dữ liệu hoặc nghiệp vụ sai."
NOTE_DATA_WRONG = "Chênh lệch %d dòng so với đáp án."
NOTE_DELTA = "Tăng %d thay vì %d"
SUMMARY_PERFECT = "Hoàn hảo - khớp hoàn toàn"
SUMMARY_EQUAL = "Khớp hoàn toàn"
SUMMARY_BUSINESS_WRONG = "Nghiệp vụ sai"
SUMMARY_DIFFERENT = "Chênh lệch"
TABLE_COMPLETE = "ĐỦ"
TABLE_INCOMPLETE = "THIẾU"

# Column headings of the report files.
SUMMARY_HEADINGS = {
    "submission_id": "MSSV",
    "column_ratio": "Tỷ lệ cột đúng",
    "fk_ratio": "Tỷ lệ khóa ngoại đúng",
    "data_ratio": "Tỷ lệ nhập dữ liệu đúng",
    "business_ratio": "Tỷ lệ nghiệp vụ đúng",
    "view_ratio": "Tỷ lệ view đúng",
    "mark_a1": "Điểm A1",
    "mark_a2": "Điểm A2",
    "mark_a3": "Điểm A3",
    "mark_b": "Điểm B",
    "mark_c": "Điểm C",
    "total": "Tổng điểm",
}
COUNT_HEADINGS = {
    "submission_id": "MSSV",
    "ans_table": "Tên bảng đáp án",
    "original_name": "Tên bảng sinh viên",
    "answer_count": "Số dòng đáp án",
    "student_count": "Số dòng sinh viên",
    "difference": "Chênh lệch",
    "data_ok": "Đã nhập đúng dữ liệu",
    "rule_ok": "Đã nhập đúng nghiệp vụ",
    "business_table": "Là bảng nghiệp vụ",
    "business_points": "Điểm nghiệp vụ",
    "status": "Trạng thái",
    "note": "Ghi chú",
}
COUNT_SUMMARY_HEADINGS = {
    "submission_id": "MSSV",
    "ans_table": "Tên bảng đáp án",
    "original_name": "Tên bảng sinh viên",
    "answer_count": "Số dòng đáp án",
    "student_count": "Số dòng sinh viên",
    "difference": "Chênh lệch",
    "rows_match": "Số dòng khớp",
    "business_done": "Đã nhập đúng nghiệp vụ",
    "business_table": "Là bảng nghiệp vụ",
    "business_points": "Điểm nghiệp vụ",
    "data_status": "Trạng thái data",
    "note": "Ghi chú",
}
DELTA_HEADINGS = {
    "submission_id": "MSSV",
    "table_name": "Tên bảng",
    "answer_count": "Số dòng đáp án",
    "student_count": "Số dòng sinh viên",
    "expected_increase": "Tăng mong đợi",
    "actual_increase": "Tăng thực tế",
    "correct": "Số dòng khớp",
    "all_correct": "Đã nhập đúng nghiệp vụ",
    "points": "Điểm",
    "note": "Ghi chú",
}
PAIR_HEADINGS = {
    "ans_table": "AnsTbl", "ans_col": "AnsCol", "ans_type": "AnsType", "stu_table": "StuTbl",
    "stu_col": "StuCol", "stu_type": "StuType", "score": "Cos", "match": "Match",
}
