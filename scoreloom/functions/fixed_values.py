"""Word lists, patterns and constants that results depend on. Nothing here is logic."""

DIMENSIONS = ("规范依据相关性", "涵摄链条对齐度", "价值衡量与同理心对齐度", "关键事实与争点覆盖度", "裁判结论与救济配置一致性")
GRADES = ("高度可靠（专业可用）", "基本可靠（需人工复核关键点）", "可参考但不宜直接使用", "不可靠/不可用")
FAILED_GRADE = "处理失败"
MINOR, MODERATE, MAJOR = "微小错误", "明显错误", "重大错误"
NO_FLAGS = ("无", "无。", "无错误", "无错误标记", "")
NO_ITEM = ("无", "无。")
BLAME_WORDS = ("受害者责备", "伦理不可接受", "责难受害者")
NEGATIONS = ("未出现", "不存在", "没有", "不包含", "不涉及", "未涉及", "未发生", "不构成")
FABRICATION_WORDS = ("编造事实", "虚构")

STALE_LAW_V1 = ("已废止", "已废除", "废止", "废除", "已失效", "失效", "过期", "不再适用", "旧法", "已修订")
STALE_LAW_V2 = ("废弃", "废止", "已废除", "已废止", "失效", "过期", "旧法", "旧版", "已修订", "已修改", "不再适用", "已失效", "已过期", "废除")

LEGAL_KEYWORDS = (
    "判决", "裁定", "认定", "适用", "依据", "违反", "构成", "责任", "赔偿", "损失", "证据", "事实",
    "法律", "法规", "条款", "规定", "支持", "驳回", "撤销", "维持", "变更", "确认", "无效", "有效",
)
PHRASE_VERBS = ("支持", "驳回", "认定", "判决")
OUTCOME_KEYWORDS = ("支持", "驳回", "认定", "判决", "维持", "撤销", "变更")
CITATION_PATTERN = r"第[一二三四五六七八九十\d]+条|《[^》]+》|法[^，。]*"

# Masking rules: (pattern, replacement), in the order in which they apply.
SENSITIVE_RULES = (
    (r"[（(]\d{4}[）)][一-龥]{0,10}\d{1,10}[一-龥]{0,5}\d{0,10}号", "（某年）某号"),
    (r"[（(]\d{4}[）)][一-龥]{0,10}\d{1,10}号", "（某年）某号"),
    (r"[一-龥]+字[〔\[]\d{4}[〕\]]\d+号", "某字〔某年〕某号"),
    (r"公民身份号码[：:]?[Xx\d]{15,18}", "公民身份号码XXX"),
    (r"身份证号[：:]?[Xx\d]{15,18}", "身份证号XXX"),
    (r"身份证号码[：:]?[Xx\d]{15,18}", "身份证号码XXX"),
    (r"1[3-9]\d{9}", "XXX"),
    (r"\d{3,4}[-－]\d{7,8}", "XXX"),
    (r"\d{2,4}[×*Xx]{4,}\d{2,4}", "XXX"),
    (r"账号[：:]?\d{10,}", "账号XXX"),
    (r"账户[：:]?\d{10,}", "账户XXX"),
)
DATE_RULES = (
    (r"[二三四五六七八九〇零一十]+年[一二三四五六七八九十]+月[一二三四五六七八九十]+[日号]", "某年某月某日"),
    (r"\d{4}年\d{1,2}月\d{1,2}日", "某年某月某日"),
    (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", "某年某月某日"),
    (r"\d{4}年", "某年"),
    (r"某年\d{1,2}月\d{1,2}日\d{1,2}时\d{1,2}分", "某年某月某日某时某分"),
    (r"某年\d{1,2}月\d{1,2}日\d{1,2}时", "某年某月某日某时"),
    (r"某年\d{1,2}月\d{1,2}日", "某年某月某日"),
    (r"某年某月某日\d{1,2}时\d{1,2}分", "某年某月某日某时某分"),
    (r"某年某月某日\d{1,2}时", "某年某月某日某时"),
)
LOCATION_RULES = (
    (r"[一-龥]+\d+号楼\d+单元\d+号", "某地址"),
    (r"[一-龥]+[\d\-]+[\d\-]+[\d号]*(?!月|日|时|分)", "某地址"),
    (r"[一-龥]{2,8}(?:省|自治区|直辖市|特别行政区)", "某省"),
    (r"[一-龥]{2,8}(?:市|州|盟|地区)", "某市"),
    (r"[一-龥]{2,8}(?:县|区|旗|自治县|自治旗)", "某县"),
    (r"[一-龥]{2,8}(?:路|街|道|巷|弄|胡同)", "某路"),
    (r"[一-龥]{2,8}(?:号|栋|幢|单元|室|层)", "某号"),
)
GENDER_NAME_PATTERN = r"([一-龥]{2,4})(?:[,，]?)(?:女|男)(?=[，。；：\s、]|$)"
NAME_RULES = (
    (r"[一-龥]{1,2}某(?:女|男)(?=[，。；：\s、]|$)", "某"),
    (r"(原告|被告|上诉人|被上诉人|原审原告|原审被告|申请人|被申请人)([：:]?)[一-龥]{2,4}(?=[，。；：\s、与在和为是向]|$)", "$1$2某"),
    (r"(证人|证明人)([：:]?)[一-龥]{2,4}(?=[，。；：\s、]|$)", "$1$2某"),
    (r"(审判长|审判员|书记员|法官助理|代理审判员)([：:]?)[一-龥]{2,4}(?=[，。；：\s、]|$)", "$1$2某"),
    (r"(委托诉讼代理人|委托代理人|诉讼代理人)([：:]?)[一-龥]{2,4}(?=[，。；：\s、]|$)", "$1$2某"),
    (r"[一-龥]某某(?=[，。；：\s、等]|$)", "某"),
    (r"[一-龥]某(?:甲|乙|丙|丁|戊|己|庚|辛|壬|癸)(?=[，。；：\s、]|$)", "某"),
    (r"[一-龥]某某(?=等|$)", "某"),
    (r"[一-龥]某(?=[，。；：\s、与在和为是向等]|$)", "某"),
)
#: What a match of the rules above holds one of at least, and all that it may hold, as insides of a class. At most one character
#: behind a match is looked at.
MASK_ANCHORS = r"一-龥\d"
MASK_CHARACTERS = MASK_ANCHORS + r"（(）)〔\[〕\]：:Xx\-－×*,，/"
STANDALONE_NAME_PATTERN = r"[一-龥]{2,4}(?=[，。；：\s、与在和为是向等]|$)"
LEGAL_TERMS = (
    "原告", "被告", "上诉人", "被上诉人", "法院", "本院", "一审", "二审", "审理", "提供", "共同", "一起", "申请", "裁定", "判决", "认为", "经", "的", "和",
    "与", "在", "为", "是", "有", "不", "也", "都", "就", "还", "可以", "能够", "应该", "需要", "必须", "可能", "如果", "因为", "所以", "但是",
    "然而", "因此", "据此", "依法", "根据", "按照", "依照", "依据", "关于", "对于", "由于", "鉴于", "经过", "通过", "进行", "完成", "实现", "达到", "取得",
    "获得", "得到", "受到", "遭受", "汉族", "朝鲜族", "满族", "回族", "某省", "某市", "某县", "某路", "某号", "某年", "某月", "某日", "出生", "民事", "刑事",
    "行政", "纠纷", "案件", "诉讼", "代理", "委托", "法庭", "审判", "决定", "执行",
)
ROLE_TERMS = ("证人", "证明人", "审判长", "审判员", "书记员", "法官助理")
CORRECTIONS = (("原某", "原告"), ("被某", "被告"), ("上诉某", "上诉人"), ("被上诉某", "被上诉人"))

# Document markers.
REASONING_PATTERNS = ("本院经审查认为[，,：:]", "本院经审理认为[，,：:]", "本院审理认为[，,：:]", "本院认为[，,：:]")
REASONING_END = "本判决为终审判决|本裁定为终审|审判长|书记员"
DECISION_PATTERN = "(?:判决如下|裁定如下|裁判结果)[：:]"
NEXT_DECISION = "(?:判决如下|裁定如下)[：:]"
DECISION_END_FINAL = "本判决为终审|本裁定为终审"
DECISION_END_NAMES = "审判长|书记员"
RESIDUAL_MARKERS = ("本院认为", "裁定如下", "判决如下")
HAN_DATE = "([二三四五六七八九〇零一十]+)年([一二三四五六七八九十]+)月([一二三四五六七八九十]+)[日号]"
ARABIC_DATE = r"(\d{4})[年\-/](\d{1,2})[月\-/](\d{1,2})日?"

PRICES = (
    ("DeepSeek-V3", 2.0, 8.0), ("DeepSeek-R1", 4.0, 16.0), ("GPT-4o", 36.0, 108.0), ("GPT-4 Turbo", 72.0, 216.0),
    ("Gemini 2.5 Pro", 9.0, 72.0), ("Gemini 2.0 Flash", 0.72, 2.88), ("Qwen-Max", 0.86, 3.46),
)
FALLBACK_CASE_TOKENS = (25088, 17938)
CHART_PRICES = (
    ("Gemini 2.0 Flash", 0.72, 2.88), ("Qwen-Max", 0.86, 3.46), ("DeepSeek-V3", 2.0, 8.0), ("DeepSeek-R1", 4.0, 16.0),
    ("Gemini 2.5 Pro", 9.0, 72.0), ("GPT-4o", 36.0, 108.0), ("GPT-4 Turbo", 72.0, 216.0),
)
CHART_CASE_TOKENS = (45698, 25251)
RUNNING_PRICES = (2.0, 8.0)
