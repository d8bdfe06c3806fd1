"""Domain vocabulary and parameters that results depend on."""

# Report catalog (code, name, aliases), in catalog order.
ENTITIES = [
    ("601398", "工商银行", ["中国工商银行", "工商银行", "工行", "ICBC"]),
    ("601939", "建设银行", ["中国建设银行", "建设银行", "建行", "CCB"]),
    ("601288", "农业银行", ["中国农业银行", "农业银行", "农行", "ABC"]),
    ("601988", "中国银行", ["中国银行", "中行", "BOC"]),
    ("601328", "交通银行", ["交通银行", "交行", "BOCOM"]),
    ("600036", "招商银行", ["招商银行", "招行", "CMB"]),
    ("601166", "兴业银行", ["兴业银行", "兴业", "兴行"]),
    ("600000", "浦发银行", ["上海浦东发展银行", "浦发银行", "浦发", "SPDB"]),
    ("601998", "中信银行", ["中信银行", "中信", "CNCB"]),
    ("600016", "民生银行", ["中国民生银行", "民生银行", "民生"]),
    ("601818", "光大银行", ["中国光大银行", "光大银行", "光大"]),
    ("000001", "平安银行", ["平安银行", "平安"]),
]

# Terms and what a question that holds them is extended by, in order.
SYNONYMS = [
    ("净息差", ["净利息收益率", "净利差", "NIM"]),
    ("净利息收益率", ["净息差", "净利差"]),
    ("净利差", ["净息差", "净利息收益率"]),
    ("手续费及佣金净收入", ["手续费及佣金收入", "中间业务收入"]),
    ("归母净利润", ["归属于本行股东的净利润", "归属于母公司股东的净利润"]),
    ("利息净收入", ["净利息收入"]),
    ("不良贷款率", ["不良率", "不良贷款比率"]),
    ("拨备覆盖率", ["贷款拨备覆盖率", "拨备率"]),
    ("资本充足率", ["资本充足水平"]),
    ("成本收入比", ["成本收入比率"]),
    ("营业收入", ["营收"]),
]

# Section names and the keywords that lead to them, by priority.
SECTION_RULES = [
    ("管理层讨论与分析", ["管理层讨论与分析", "经营情况讨论与分析", "讨论与分析", "管理层讨论及分析"]),
    ("财务报表附注", ["财务报表附注", "财务报告附注", "会计报表附注"]),
    ("财务报告", ["财务报告", "财务报表", "审阅报告", "中期财务报表"]),
    ("公司治理", ["公司治理"]),
    ("重要事项", ["重要事项", "重大事项"]),
    ("股份变动及股东情况", ["股份变动", "股东情况", "董事、高级管理人员", "董事、监事"]),
    ("债券相关情况", ["债券相关情况", "债券情况"]),
    ("环境、社会与治理", ["环境、社会与治理", "环境和社会", "社会责任", "ESG"]),
    (
        "公司简介与主要财务指标",
        [
            "公司简介", "本行简介", "主要财务指标", "公司基本情况", "会计数据和财务指标",
            "财务数据和财务指标", "财务摘要", "主要会计数据",
        ],
    ),
    ("重要提示与释义", ["重要提示", "释义", "备查文件"]),
]
UNKNOWN_SECTION = "未识别"

# Patterns of headings, tables of contents and numeric cells.
CHAPTER = r"^第\s*[一二三四五六七八九十百]+\s*[节章]"
CHAPTER_ALONE = r"^第\s*[一二三四五六七八九十百]+\s*[节章]\s*$"
DOT_LEADER = r"[.·…]{3,}"
DOT_LEADER_TAIL = r"[.·…]+\s*\d*\s*$"
TITLE_NUMBER = r"^\d+(?:[.\-、]\d+)*[.、]?"
DOCUMENT_TITLE = r"半年度报告|年度报告|季度报告|上传稿|定稿|正文\)|_定稿"
NUMERIC_CELL = r"^[\d,.\-()%<>≤≥]+$"

# Title words that a report needs, and words that rule a title out, in order.
TITLE_REQUIRED = ["半年度报告", "半年报"]
TITLE_EXCLUDED = [
    "摘要", "英文", "English", "更正", "补充", "取消", "废止", "修订", "提示性", "公告", "说明", "问询", "反馈", "H股",
]
TITLE_YEAR = "2026"
TITLE_DEFAULT_REASON = "标题不含半年报关键词"

# Templates.
DOC_LABEL = "2026年半年度报告"
QUERY_TASK = "为这个句子生成表示以用于检索相关文章："
TABLE_HEADER_MARK = "[表头] "
REFUSAL = "无法回答"

# Parameters.
RRF_K, ROUTE_DEPTH, TOP = 60, 10, 6
CHUNK_TOKENS, OVERLAP_TOKENS = 1200, 150
LOW_TEXT = 100
NARROW_COVERAGE = 0.55
COLUMN_TOLERANCE, ROW_TOLERANCE = 3.0, 4.0
HEADING_CHARS = 30
TOC_MARKS = 4
SECTION_KINDS = 3
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SAMPLE_SEED = 20260630
MIN_FILE_BYTES, PAGE_SIZE = 10_240, 30
