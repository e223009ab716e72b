"""Fixed values.

Everything in this module must stay equal to the behaviour being reproduced:
keyword lists, marker lists, the KPI ladder, the time zone, captions and the
fallback label. They are kept here as plain text, in their natural order, so
that the rest of the package only holds logic. Do not edit them to make a test
pass; they are data, and the topic rules can be replaced at run time through
``chatlens.functions.rules.RuleSet`` (the user-editable rule set).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — time zone and fallback label
# ---------------------------------------------------------------------------
LOCAL_TIME_ZONE = "Asia/Ho_Chi_Minh"
FALLBACK_LABEL = "Khác"

# ---------------------------------------------------------------------------
# FIXED VALUES — default topic rules (ordered: first matching topic wins).
# Keywords keep their exact spelling, case and blanks (" nhà cung cấp" and
# "làm sao để " carry significant blanks); duplicates are kept as given.
# ---------------------------------------------------------------------------
DEFAULT_TOPIC_RULES: list[tuple[str, list[str]]] = [
    ("Kinh doanh", ["doanh thu", "doanh số", "P&L", "chốt deal", "CRM", "báo cáo kinh doanh", " nhà cung cấp"]),
    ("Nội dung/Kế hoạch", ["quảng cáo", "chiến dịch", "meta ads", "google ads", "seo", "content", "nội dung",
                           "thương hiệu", "branding", "viết", "văn bản"]),
    ("Tuyển dụng/HR", ["jd", "tuyển", "phỏng vấn", "chế độ", "lương", "onboarding", "OKR", "đánh giá", "performance",
                       "kpi", "phúc lợi", "benefits", "hợp đồng lao động", "hợp đồng thử việc", "hợp đồng chính thức",
                       "hợp đồng lao động thời vụ", "hợp đồng cộng tác viên", "hợp đồng khoán việc", "ứng viên",
                       "candidate", "recruitment", "hồ sơ ứng viên", "job description", "employee handbook"]),
    ("Pháp lý", ["hợp đồng", "nhà thầu", "chủ đầu tư", "gói thầu", "bên a", "bên b", "phụ lục", "điều khoản", "pháp lý",
                 "luật", "tuân thủ", "compliance", "kiện", "tranh chấp", "thỏa thuận", "agreement", "legal", "khoản",
                 "điều", "nghị định", "nghị quyết"]),
    ("Tài chính/Kế toán", ["hóa đơn", "ngân sách", "bút toán", "báo cáo tài chính", "thuế", "vat", "invoice", "budget",
                           "accounting", "financial report", "tax", "kiểm toán", "audit", "financial statement",
                           "balance sheet", "profit and loss", "cash flow"]),
    ("Vận hành", ["quy trình", "SOP", "quy định", "quản trị", "biểu mẫu", "quản lý xây dựng"]),
    ("Học thuật", ["học thuật", "so sánh", "check lại", "nghiên cứu", "bài báo", "tài liệu học thuật", "academic",
                   "research", "paper", "xử lý", "thế nào", "lesson plan", "công thức", "cách tính"]),
    ("Tra cứu", ["trích", "tra cứu", "viết tắt", "bao nhiêu", "vậy còn", "làm sao để ", "là gì", "là sao", "tại sao",
                 "đọc file", "tìm kiếm", "lookup", "thông tin", "data", "cơ sở dữ liệu", "database", "tài liệu",
                 "hướng dẫn", "là gì?"]),
    ("Dịch thuật", ["dịch", "dich", "dich sang", "chuyển ngữ", "Chuyển sang song ngữ Anh - Việt", "translate",
                    "phiên dịch", "bản dịch", "ngôn ngữ", "tiếng anh", "tiếng việt"]),
    ("CSKH", ["hỗ trợ", "khách hàng", "phản hồi", "ticket", "trợ giúp", "giải đáp"]),
    ("Xây dựng", ["thi công", "công trình", "dự án", "xây dựng", "kiến trúc", "bê tông", "kỹ sư", "giám sát",
                  "thiết kế kiến trúc", "construction", "project management", "architectural design", "engineering"]),
    ("Báo cáo", ["báo cáo", "report", "thống kê", "phân tích", "dashboard", "biểu đồ", "chart", "data analysis"]),
    ("Hỗ trợ Thiết kế", ["thiết kế", "đồ họa", "sketchup", "autocad", "bản vẽ", "mockup", "prototype", "edit",
                         "viền mỏng", "viền dày", "màu sắc", "font chữ", "logo", "branding", "design", "graphic design",
                         "sketchup", "autocad", "photoshop", "illustrator", "mm", "cm", "inch", "pixel", "dpi",
                         "resolution", "vector", "raster", "layout", "composition", "typography"]),
    ("Email", ["email", "thư điện tử", "gửi mail", "trả lời email", "hộp thư", "outlook", "gmail"]),
    ("QLHC", ["mua", "chỗ mua", "tìm mua", "ncc", "thiết bị", "vật tư", "văn phòng phẩm", "đặt mua", "đặt hàng",
              "nhà cung cấp", "vendor", "procurement", "supply", "supply chain", "NCC"]),
    ("Kỹ thuật/Phần mềm/IT", ["api", "sơ đồ", "giả lập", "giao diện", "học sâu", "học máy", "chức năng", "window",
                              "file", "code", "router", "nguồn", "excel", "word", "pdf", "sharepoint", "database",
                              "script", "server", "deploy", "bug", "log", "python", "sql", "in ấn", "sửa lỗi",
                              "sửa chữa", "bảo trì", "cài đặt", "hệ thống", "mạng", "network", "AI HUb", "chatgpt",
                              "openai", "gpt-3.5", "gpt-4", "llm", "machine learning", "deep learning",
                              "trí tuệ nhân tạo", "artificial intelligence", "chatbot", "model", "training",
                              "fine-tuning", "prompt engineering", "android", "ios", "app development",
                              "web development", "frontend", "backend", "fullstack", "javascript", "react", "vue",
                              "angular", "nodejs", "express", "django", "flask", "ruby on rails", "kích thước",
                              "file excel"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — purpose rules (ordered: first matching purpose wins; not
# user-editable).
# ---------------------------------------------------------------------------
PURPOSE_RULES: list[tuple[str, list[str]]] = [
    ("Tra cứu", ["tra cứu", "tra cuu", "lookup", "search", "tìm", "tìm kiếm", "là gì", "bao nhiêu", "tại sao", "how",
                 "what"]),
    ("Tóm tắt", ["tóm tắt", "tóm tat", "summary", "summarize", "tổng kết", "phân tách", "đúc kết", "tóm lược"]),
    ("Viết mail", ["email", "mail", "thư", "gửi mail", "viết mail", "trả lời email", "reply email", "forward"]),
    ("Học tập", ["học", "học tập", "learn", "study", "bài học", "lesson", "giảng", "nghiên cứu"]),
    ("Dịch thuật", ["dịch", "dich", "translate", "dịch sang", "chuyển ngữ", "phiên dịch"]),
    ("Viết code", ["code", "python", "java", "c++", "javascript", "program", "script", "sql", "lập trình"]),
    ("Báo cáo", ["báo cáo", "report", "thống kê", "dashboard", "biểu đồ", "chart"]),
    ("Kế hoạch", ["kế hoạch", "plan", "planning", "project", "dự án", "chiến dịch"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt-quality heuristic.
# Length band by word count: (upper bound exclusive, points); the last band
# applies to everything at or above the last bound.
# Marker groups: (points, markers); a group scores once if any marker occurs
# (case-insensitive substring).
# ---------------------------------------------------------------------------
QUALITY_LENGTH_BANDS: list[tuple[int, int]] = [(5, 5), (15, 20), (60, 35), (200, 30)]
QUALITY_LENGTH_TOP_POINTS = 25
QUALITY_MARKER_GROUPS: list[tuple[str, int, list[str]]] = [
    ("context", 15, ["bối cảnh", "context", "dữ liệu", "input", "tham số", "giả định", "assume", "role:", "giả sử",
                     "bạn là"]),
    ("constraints", 15, ["định dạng", "format", "tiêu đề", "mục", "bullet", "json", "bảng", "số từ", "ký tự", "tone"]),
    ("ask_verbs", 15, ["viết", "tóm tắt", "dịch", "giải thích", "liệt kê", "so sánh", "phân tích", "đưa ra", "tạo",
                       "generate", "summarize", "translate", "explain", "viết code"]),
    ("examples", 10, ["ví dụ", "example", "mẫu"]),
    ("domain", 10, ["hợp đồng", "báo cáo", "phân tích", "mã code", "fix code", "biên bản", "đấu thầu", "ngân sách",
                    "marketing", "CRM", "quy trình", "SOP"]),
]
QUALITY_MIN, QUALITY_MAX = 0, 100

# ---------------------------------------------------------------------------
# FIXED VALUES — KPI ladder, first matching row wins, all conditions ANDed.
# Columns: label, raw score, min prompts, min active days, min unique topics,
# min avg user messages per conversation, min avg words per prompt,
# alternative min active days (OR-ed with min prompts; None = not used).
# None means "no condition". The last two rows are handled as: any prompt ->
# "Thấp"; no prompt -> "Không sử dụng".
# ---------------------------------------------------------------------------
KPI_LADDER: list[tuple[str, int, int | None, int | None, int | None, float | None, float | None, int | None]] = [
    ("Xuất sắc", 100, 200, 25, 17, 10.0, 40.0, None),
    ("Rất tốt", 95, 150, 22, 14, 8.0, 35.0, None),
    ("Tốt+", 90, 120, 16, 12, 6.0, 30.0, None),
    ("Tốt", 85, 100, 14, 10, 5.0, 25.0, None),
    ("Khá", 80, 100, 12, None, 4.0, 20.0, None),
    ("Trung bình", 50, 100, None, None, 3.0, 15.0, 5),
]
KPI_LOW = ("Thấp", 25)
KPI_NONE = ("Không sử dụng", 0)

# ---------------------------------------------------------------------------
# FIXED VALUES — report captions (column name -> original caption), in the
# report's column order.
# ---------------------------------------------------------------------------
REPORT_CAPTIONS: list[tuple[str, str]] = [
    ("department", "Tiêu đề"),
    ("ordinal", "#"),
    ("month_label", "Tháng"),
    ("active_days", "Active Days (số ngày có sử dụng)"),
    ("conversations", "Số lượng hội thoại"),
    ("avg_prompts_per_conversation", "Số lượng tin nhắn trung bình trong mỗi hội thoại"),
    ("avg_words_per_prompt", "Độ dài trung bình câu prompt (từ)"),
    ("purpose_distribution", "Mục đích sử dụng (Tra cứu, tóm tắt, Viết mail, học tập,...) kèm %"),
    ("topic_distribution", "Chủ đề (Tuyển dụng, Thuế, ...) kèm %"),
    ("rating", "Đánh giá chất lượng theo A3 (Xuất sắc, Rất tốt, Tốt+, Tốt, Khá, Trung bình, Thấp, Không sử dụng)"),
    ("kpi_score", "Điểm KPIs %"),
]

# Transcript speaker labels: "User" for role 'user', "Assistant" for any other role.
SPEAKER_USER, SPEAKER_OTHER = "User", "Assistant"
