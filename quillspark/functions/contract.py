"""Values fixed by the data contract. Results depend on them being exactly these."""

# Separators and version tags.
PART_SEPARATOR = "\x1f"
PARSER_VERSION = "evidence_parser_v1"
CHUNKER_VERSION = "utf8_paragraph_1200_160_v1"
TOKENIZER_VERSION = "zh_unigram_bigram_latin_v1"
SNAPSHOT_SCHEME = "evidence_source_snapshot_v1"
LEXICAL_INDEX_VERSION = "bucketed_postings_v3"
SHORT_TEXT_TYPO = "测式"

# Chunk and cluster sizes.
MAX_CHUNK_BYTES = 1200
CHUNK_OVERLAP_BYTES = 160
MIN_CUT_SHARE = 3 / 5
COMMENT_CLUSTER_SIZE = 12
CHUNK_BOUNDARIES = "\n.!?;:,。！？；：，"

# Retrieval limits, thresholds and weights.
MAX_QUERY_CHARS = 2000
MAX_QUERY_TERMS = 64
MAX_CANDIDATE_TERMS = 12
MATCH_TERMS = 6
CANDIDATE_LIMIT = 240
RESULT_LIMIT = 10
MAX_PER_NOTE = 2
RELATIVE_CUTOFF = 0.72
UNKNOWN_TERM_WEIGHT = 8.0
LEXICAL_WEIGHTS = {"coverage": 0.78, "fts": 0.14, "trigram": 0.08}
LEXICAL_BONUS = {"hint": 0.34, "type": 0.14, "position": 0.08}
HYBRID_WEIGHTS = {"rrf": 0.45, "vector": 0.35, "lexical": 0.20}
RRF_BASE = 61
RRF_SCALE = 30.5
SEARCHABLE_STATES = ["ready", "superseded"]
THRESHOLDS = {"lexical": 0.30, "vector": 0.45, "hybrid": 0.60}
DOCUMENT_TYPES = ["note", "note_media", "note_comment_cluster", "note_daily_fact", "user_daily_fact"]

# Query phrases.
QUERY_INSTRUCTION = (
    "Instruct: Given a creator-content platform question, retrieve Chinese evidence passages that answer the query\nQuery: "
)
GENERIC_BIGRAMS = [
    "一个", "一份", "不能", "不要", "什么", "以及", "作者", "依据", "其中", "分别", "只要", "只能",
    "可以", "如何", "是否", "最终", "有关", "根据", "样本", "每个", "没有", "然后", "现在", "相关",
    "笔记", "给出", "记录", "这个", "这些", "这份", "那个", "那些", "里面", "需要", "问题",
]
NOTE_WORD = "笔记"
NOTE_ID_PATTERN = r"(?:笔记|样本记录|记录)\s*([0-9]{1,12})"
LONG_NUMBER_PATTERN = r"\b([1-9][0-9]{3,11})\b"
POSITION_PATTERN = r"位置\s*([0-9]{1,6})"
SUBJECT_PATTERN = "(?:根据|查找)[“\"]([^”\"]{2,80})[”\"]"
MEDIA_PHRASES = ["图片文字", "图中文字"]
COMMENT_PHRASES = ["评论区", "评论内容"]
FACT_PHRASES = ["日事实", "每日事实"]

# Behaviour event names and counter weights.
NOTE_VIEW_EVENTS = ["note_viewed", "media_viewed"]
USER_VIEW_EVENTS = ["note_viewed", "media_viewed", "comments_viewed"]
INTERACTION_EVENTS = [
    "note_liked", "note_unliked", "note_collected", "note_uncollected",
    "note_shared", "comment_liked", "comment_unliked",
]
DOMAIN_EVENTS = [
    "note.created", "note.updated", "note.deleted", "note.viewed",
    "comment.created", "comment.deleted", "note.liked", "note.unliked",
    "note.collected", "note.uncollected", "note.shared", "comment.liked", "comment.unliked",
]
HOT_WEIGHTS = {"view_count": 1, "like_count": 3, "collect_count": 8, "comment_count": 6, "share_count": 5}
COMMENT_LIKE_WEIGHT = 5
COMMENT_VALUE_BONUS = {"intent": 80, "sentiment": 40, "topic": 20}

# Daily-fact texts (label of each measure, in order).
NOTE_FACT_TEXT = (
    "笔记日事实\n日期: %s\n笔记ID: %d\n浏览: %d\n点赞: %d\n收藏: %d\n评论: %d\n分享: %d\n独立用户: %d\n事件总数: %d"
)
USER_FACT_TEXT = (
    "用户日事实\n日期: %s\n用户ID: %d\n浏览: %d\n互动: %d\n发帖: %d\n评论: %d\n活跃笔记: %d\n事件总数: %d"
)

# Evaluation task names and gates.
NO_RELEVANT_TASKS = ["no_relevant_document", "out_of_domain_noise"]
INSUFFICIENT_TASK = "insufficient_evidence"
AUTHORIZATION_TASK = "authorization_boundary"
DEVELOPMENT_GATES = {
    "recall_at_10": 0.85, "mrr_at_10": 0.70,
    "no_relevant_rejection_accuracy": 0.85, "citation_precision": 0.90,
}
ANSWERABILITY_KAPPA_GATE = 0.80
RELEVANCE_KAPPA_GATE = 0.70

# Tasks and their query templates.
TASKS = [
    "semantic_paraphrase", "typo_robustness", "temporal_conflict",
    "cross_note_compare", "no_answer", "authorization_boundary",
]
CASE_TEMPLATES = {
    "semantic_paraphrase": "如果我的情况接近{audience}，而且处于{context}，关于{subject}最稳妥的结论是什么？记录线索是“{metric}”。",
    "typo_robustness": "对{audience}来说，材料里提到的“{typo}”最后建议是什么？对应记录线索是“{metric}”。",
    "temporal_conflict": "{subject}中提到“{metric}”，这能否直接外推成长期普遍结论？应保留什么时间边界？",
    "cross_note_compare": "比较面向{audience}的“{subject}”（线索：“{metric}”）和面向{peer_audience}的“{peer_subject}”（线索：“{peer_metric}”），不要把两篇材料混为一个来源。",
    "no_answer": "现有关于{subject}在{context}中的材料只有“{metric}”，能否证明它对全国所有用户具有确定的长期因果效果？",
    "authorization_boundary": "在有权访问项目 {project} 的前提下，为了{goal}，{subject}中带有“{metric}”线索的核心结论是什么？",
}
# Expected answers other than the source's own conclusion.
CASE_ANSWERS = {
    "temporal_conflict": "不能直接外推为长期普遍结论；应保留原文观察周期、记录次数和适用条件。",
    "cross_note_compare": "{subject}：{conclusion}；{peer_subject}：{peer_conclusion}。",
    "no_answer": "不能。现有材料是有边界的个人记录，无法证明全国范围的长期因果效果。",
}
# Words for slots whose value is blank, and where a task has its own.
CASE_FALLBACKS = {
    "audience": "原文描述的人群", "context": "原文记录的场景", "metric": "有限样本观察", "goal": "原文目标",
    "peer_audience": "第二类人群", "peer_metric": "第二份有限样本观察",
}
CASE_OWN_FALLBACKS = {
    "temporal_conflict": {"metric": "有限周期的观察"},
    "cross_note_compare": {"audience": "第一类人群", "metric": "第一份有限样本观察"},
    "no_answer": {"context": "原文场景"},
}
#: Marks cut from the end of a compared conclusion, and how far ahead the compared source stands.
CASE_ANSWER_ENDS = "。；; "
CASE_PEER_DISTANCE = 17

# Sections and figures of templated note bodies.
SECTIONS = {
    "days": "做了([0-9]+)天记录",
    "records": "共完成([0-9]+)次记录",
    "budget": "预算约([0-9]+)元",
    "record": "样本记录[ ]*([0-9]+)",
    "conclusion": "(?s)【先说结论】(.*?)【具体过程】",
}
# The audience stands between the first of each mark, whose distance in bytes is limited.
AUDIENCE_MARKS = ("对", "而言")
AUDIENCE_BYTES = 120
DEFAULT_AUDIENCE = "原文描述的目标读者"
DRAFT_SHORT_TYPO = "方按"

# Limits of content rows, in bytes.
NOTE_CAPS = {"title": 255, "body": 20000, "category": 64}
MEDIA_CAPS = {"media_type": 32, "url": 512}
VISIBILITIES = ["public", "project"]
DEFAULT_VISIBILITY = "public"
DEFAULT_MEDIA_TYPE = "image"

# Gates of a corpus: name, report column, target, condition.
CORPUS_GATES = [
    ("unique_titles", "unique_title_ratio", ">= 0.98", "unique_title_ratio >= 0.98"),
    ("substantive_note_body", "minimum_body", ">= 300 characters", "minimum_body >= 300"),
    ("substantive_media_ocr", "minimum_ocr", ">= 30 characters", "minimum_ocr >= 30"),
    ("substantive_comments", "minimum_comment", ">= 35 characters", "minimum_comment >= 35"),
    ("low_comment_duplication", "duplicate_comment_ratio", "<= 0.01", "duplicate_comment_ratio <= 0.01"),
    ("semantic_alignment", "semantic_alignment_ratio", ">= 0.98", "semantic_alignment_ratio >= 0.98"),
]
MOST_EVAL_TASKS = 8

# Cache counters in a load run's metrics text.
COUNTER_LINE = r'^(cache_hit_total|cache_miss_total)\{cache="([^"]+)"\}\s+([0-9.eE+-]+)$'

# Status changes of a run that are allowed.
TRANSITIONS = {"queued": ["running", "failed", "cancelled"], "running": ["succeeded", "failed", "cancelled"]}

# Gates of an event stream: name, report column, target, condition.
DISTRIBUTION_GATES = [
    ("multi_step_sessions", "average_events", ">= 2.0", "average_events >= 2"),
    ("zipf_note_concentration", "note_share", "0.08 to 0.80", "note_share BETWEEN 0.08 AND 0.80"),
    ("active_user_concentration", "user_share", "0.20 to 0.80", "user_share BETWEEN 0.20 AND 0.80"),
    ("persona_diversity", "personas", ">= 6", "personas >= 6"),
    ("event_type_diversity", "event_types", ">= 8", "event_types >= 8"),
]
