"""Word lists, thresholds and point tables that results depend on.

Nothing here is logic.  Every list is given in its natural order because some
of them are applied in order.
"""

# Characters removed when a question is normalised (whitespace is removed too).
QUESTION_PUNCTUATION = "，。！？；：、“”‘’（）()[]【】《》<>.,!?;:\"'|"

# Characters removed by the other compacting variants (besides whitespace).
ENRICH_PUNCTUATION = "，。；：、,.!?！？（）()《》“”\"'\\-—_"
BOUNDARY_PUNCTUATION = ENRICH_PUNCTUATION + "/"
MAPPING_PUNCTUATION = "，。；：、“”‘’（）()《》〈〉【】[]—-·/"
VERIFY_PUNCTUATION = "，。；：、“”‘’（）()《》〈〉【】[]—-·"
BANK_PUNCTUATION = "。？?！!：:，,、；;“”\"'（）()[]【】—-"

# Noise words dropped from semantic keys, in order.
SEMANTIC_NOISE = ("的", "流程", "示意", "图")

# Filler phrases dropped to reach the core of a question, in order.
FILLER_PHRASES = (
    "请简要说明",
    "请按条目回答",
    "能不能按条目总结",
    "怎么理解",
    "是什么",
    "是哪些",
    "包括哪些要点",
    "包括哪些",
    "有哪些要点",
    "有哪些",
)

# Scope and intent rules: (phrase, points when the card's focused text has it,
# points when only the body has it, reason prefixes).
INTENT_PHRASES = ("包括哪些要点", "有哪些要点", "流程", "区别", "作用")
INTENT_POINTS = 30.0
SCOPE_TERMS = ("平面", "纵断面", "横断面", "交叉口", "人机分工")
SCOPE_FOCUS_POINTS = 35.0
SCOPE_BODY_POINTS = -15.0
FUNCTION_TERM = "功能"
FUNCTION_FOCUS_POINTS = 25.0
FUNCTION_BODY_POINTS = -5.0
CONTENT_TERM = "内容"
PRINCIPLE_TERM = "原则"
CONTENT_AGAINST_PRINCIPLE = -40.0
PRINCIPLE_AGAINST_CONTENT = -30.0

# Domain phrases of the hybrid ranking.
DOMAIN_PHRASES = (
    "虚实闭环",
    "数字孪生",
    "BIM+GIS",
    "CAD图元",
    "BIM构件",
    "工程语义",
    "构件化",
    "参数化",
    "协同化",
    "生命周期化",
    "模型为核心",
    "技术体系",
    "数据驱动",
    "路线适宜性",
)

# Words that show a wish for a resource, and the looser per-type lists.
RESOURCE_WORDS = (
    "资源",
    "素材",
    "脚本",
    "互动",
    "演示",
    "操作",
    "打开",
    "查看",
    "想看",
    "我想看",
    "怎么看",
    "怎么用",
    "如何使用",
    "图片",
    "示意图",
    "流程图",
    "时间轴",
    "公式",
    "计算公式",
    "变量含义",
    "表格",
    "对比表",
    "比较表",
    "一览表",
)
SCRIPT_WORDS = ("脚本", "互动", "演示", "操作", "怎么看", "怎么用", "如何使用")
IMAGE_WORDS = ("图", "图片", "示意图", "流程图")
FORMULA_WORDS = ("公式", "计算公式", "变量", "变量含义", "式")
TABLE_WORDS = ("表", "表格", "对比表")
# Stricter tests for the kind of resource asked for.
STRICT_IMAGE_WORDS = ("图片", "示意图", "流程图", "图示", "插图", "看图")
STRICT_FORMULA_WORDS = ("公式", "计算公式", "变量含义")
STRICT_TABLE_WORDS = ("表格", "对比表", "比较表", "一览表", "看表")
STRICT_IMAGE_PATTERN = r"图\s*\d+(?:[-.－—]\d+)?"
STRICT_FORMULA_PATTERN = r"式\s*\d+(?:[-.－—]\d+)?"
STRICT_TABLE_PATTERN = r"表\s*\d+(?:[-.－—]\d+)?"
WANT_TO_SEE = "我想看"

# Words of operation questions.
ERROR_WORDS = ("失败", "错误", "异常", "不显示", "不正确", "错位", "输出为空", "不能", "无法", "排查", "怎么办")
CHECK_WORDS = ("检查", "核对", "注意", "要点")
STEP_WORDS = ("如何", "怎么", "怎样", "步骤", "操作", "怎么做", "流程", "创建", "设置", "导入", "添加", "生成")

# Question categories of the question bank, first match wins.
CATEGORY_WORDS = (
    ("易混辨析", ("区别", "对比", "关系", "辨析", "原则", "内容", "为什么")),
    ("设计流程", ("流程", "步骤", "阶段", "方法", "如何", "怎么", "计算", "设计过程")),
    ("系统功能", ("功能", "模块", "组成", "作用", "系统", "具备", "任务")),
)
DEFAULT_CATEGORY = "核心概念"
RESOURCE_CATEGORY = "资源学习"

# Words that mark a teaching question.
TEACHING_WORDS = ("为什么", "如何", "作用", "区别", "适合", "体现", "注意", "复习", "应用")
TEACHING_TYPES = ("why", "application", "comparison", "summary", "review")

# Terms too general to count as evidence.
GENERIC_TERMS = ("道路", "工程", "设计", "方法", "系统", "模型", "数据", "应用", "数字", "智能", "章节")

# The same for terms of a line mapping.
MAPPING_STOP_TERMS = (
    "GIS", "道路", "工程", "分析", "方法", "模型", "系统", "数据", "空间", "应用", "组成", "原理", "基础", "问题", "关系", "功能",
)

# Evidence status -> confidence.
HIGH_EVIDENCE = ("exact", "auto_direct_text_supported")
MEDIUM_EVIDENCE = (
    "partial",
    "concept_supported",
    "auto_partial_text_supported",
    "auto_concept_operation_supported",
    "auto_concept_anchor_supported",
    "auto_teaching_summary_supported",
    "auto_boundary_fragment_supported",
)
LOW_EVIDENCE = ("missing", "auto_anchor_missing_or_weak", "auto_operation_summary_not_direct_quote")

# Review decisions and the decisions usual for a review status.
REVIEW_DECISIONS = (
    "",
    "confirm_candidate_anchor",
    "confirm_teaching_summary",
    "confirm_boundary_fragment",
    "split_required",
    "reject_candidate",
    "manual_anchor_pending",
)
USUAL_DECISIONS = {
    "candidate_anchor_review": ("confirm_candidate_anchor", "reject_candidate", "manual_anchor_pending"),
    "term_supported_summary_review": ("confirm_teaching_summary", "reject_candidate", "manual_anchor_pending"),
    "boundary_fragment_review": ("confirm_boundary_fragment", "split_required", "manual_anchor_pending"),
    "manual_anchor_required": ("manual_anchor_pending", "confirm_candidate_anchor", "reject_candidate"),
}
SUGGESTED_DECISION = {
    "candidate_anchor_review": "confirm_candidate_anchor",
    "term_supported_summary_review": "confirm_teaching_summary",
    "boundary_fragment_review": "confirm_boundary_fragment",
    "manual_anchor_required": "manual_anchor_pending",
}
EXCERPT_ROLES = {
    "term_supported_summary_review": "teaching_summary_with_term_support_not_verbatim",
    "boundary_fragment_review": "boundary_fragment_needs_manual_confirmation",
    "candidate_anchor_review": "candidate_concept_anchor_not_verbatim",
    "manual_anchor_required": "manual_textbook_anchor_required",
}

# Confidence bands of an answer score.
HIGH_SCORE = 110.0
MEDIUM_SCORE = 70.0

# Vector points: (similarity threshold, scale).
BGE_VECTOR = (0.40, 180.0)
OTHER_VECTOR = (0.84, 350.0)

# Routing between chapters.
ROUTE_STRONG_SCORE = 110.0
ROUTE_STRONG_MARGIN = 35.0
ROUTE_MIN_SCORE = 70.0
ROUTE_MARGIN = 45.0

# Answer texts.
NO_ANSWER = "教材知识库未找到直接答案。"
NO_POINTS = "教材知识库未提供可直接输出的答案要点。"
NO_STEPS = "教材知识库未提供流程步骤。"
NO_ROWS = "教材知识库未提供比较维度。"

# Truthy spellings.
TRUE_WORDS = ("1", "true", "yes", "on")
AUTO_WORDS = TRUE_WORDS + ("auto", "all")

# Formula and question shapes.
FORMULA_OPERATORS = r"[=+\-*/×÷√∑ΣπΠ≤≥<>]"
POLITE_PREFIX = r"^(请)?(简要说明|按条目回答|查看)?[：:]\s*"
QUESTION_PREFIXES = ("什么是", "何为", "如何理解")
QUESTION_SUFFIXES = ("是什么", "什么意思")

# Words that say nothing in a heading.
HEADING_STOP_TERMS = ("道路", "设计", "方法", "系统", "模型", "数据", "技术", "应用", "工程", "智能", "数字", "孪生")

# The number label of a formula, and words that show running prose around one.
FORMULA_LABEL = r"[（(]\s*\d+\s*[-－]\s*\d+\s*[）)]"
PROSE_FORMULA_MARKERS = ("按式", "由式", "采用式", "计算公式如", "可按式", "则", "当", "式中", "其中", "符号")

# Lines of an answer that students do not see: what they start with, what they name.
HIDDEN_LINE_START = "教材依据："
HIDDEN_LINE_WORDS = "Source_Chunks作为依据"

# Evidence profiles by alignment status: class, confidence, boundary, verification, review state.
EVIDENCE_PROFILE_FIELDS = ("classification", "evidence_confidence", "evidence_boundary_type", "word_verification", "review_status")
EVIDENCE_PROFILES = {
    "exact": ("direct_text_evidence", "high", "direct_text_or_heading", "auto_direct_text_supported", "auto_evidence_graded"),
    "partial": ("partial_text_evidence", "medium", "partial_text_or_heading", "auto_partial_text_supported", "auto_evidence_graded"),
    "concept_supported": (
        "concept_or_operation_anchor", "medium", "concept_supported_summary", "auto_concept_operation_supported", "auto_evidence_graded",
    ),
}
OPERATION_SUMMARY_WITH_TERMS = (
    "operation_summary_with_term_support", "medium", "operation_teaching_summary", "auto_operation_summary_not_direct_quote", "auto_evidence_graded",
)
OPERATION_SUMMARY = (
    "operation_summary_not_verbatim", "low", "operation_teaching_summary", "auto_operation_summary_not_direct_quote", "auto_evidence_downgraded",
)

# Words of comparing questions, and what separates the sides of a comparison.
COMPARISON_WORDS = ("区别", "比较")
COMPARISON_SPLIT = "与|和|/|、|vs|VS"
