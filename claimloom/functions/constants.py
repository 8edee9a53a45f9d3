"""Word lists, patterns, thresholds and formats that results depend on."""

# --- fixed values: tokens and stop words
TOKEN = "[a-z0-9]+"
CONTENT_WORD = r"(?U)\b[a-z]{3,}\b"
GATE_STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "its",
    "now", "old", "see", "two", "who", "did", "did", "not", "does", "from", "into", "know", "let", "man", "new", "other", "over", "said", "she",
    "the", "their", "them", "then", "there", "they", "this", "was", "way", "with",
)
PAIR_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that",
    "the", "this", "to", "was", "were", "will", "with", "not", "no", "did", "does", "do", "than", "their", "his", "her", "they", "them", "but",
)
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "was", "were", "with",
)

# --- fixed values: evidence markers and rendering styles; the markers are one pattern, as one replacement takes them all off
MARKERS = r"(?i)^(?:(?:\[(?:E?\d+)\]|passage\s+\d+\s*:|evidence\s+[a-z]\s*:)\s*|[-*•]\s+)+"
STYLES = ("plain", "passage", "evidence_letter", "bullet", "bracket")

# --- fixed values: labels
SUPPORTED, REFUTED, NEI, NEI_DISK = "SUPPORTED", "REFUTED", "NOT ENOUGH INFO", "NOT_ENOUGH_INFO"
LABELS = (SUPPORTED, REFUTED, NEI)

# --- fixed values: rule verifier
SUPPORT_OVERLAP = 0.45
HIT, MISS = 0.7, 0.1
NO_EVIDENCE_CONFIDENCE = 0.34
ABSTAIN_BELOW, MAX_RETRIES = 0.55, 2

# --- fixed values: retrieval
BM25_K1, BM25_B, RRF_K, HASH_DIM = 1.5, 0.75, 60, 64
INDEX_WINDOWS = ("section", "context_window", "prev_sentence", "next_sentence", "window")

# --- fixed values: citations
CITATION = r"\[(\d+)\]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
CITED_SENTENCE_END = r"(?U)(?<=[.!?])\s+|;\s+"
SUPPORT_SHARE = 0.2

# --- fixed values: the prompt for an explanation, with places for claim, verdict and evidence
EXPLANATION_PROMPT = """You are a fact-checking assistant.
Claim: {}
Verdict: {}
Evidence:
{}
Write a concise explanation grounded in the evidence and cite each sentence with bracketed evidence ids.
"""

# --- fixed values: ranking features, in order
FEATURES = ("bm25_score", "dense_similarity_score", "cross_encoder_score", "lexical_overlap", "number_overlap", "date_overlap", "evidence_length", "claim_length", "bm25_rank_position", "dense_rank_position")
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
DATES = (r"(?U)\b\d{4}\b", r"(?U)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b")

# --- fixed values: claim categories
NEGATIONS = ("not ", "never", "no ")
MONTHS = (" january", " february", " march", " april", " may ", " june", " july", " august", " september", " october", " november", " december")
QUESTION_WORDS = ("who", "where", "which", "what")
CAUSAL_WORDS = ("because", "therefore", "as a result")

# --- fixed values: training artefacts
PROMPT_HEAD = "You are a fact-verification assistant. Use only the provided evidence.\n\n"
PROMPT_TAIL = "Write a concise explanation. Cite the evidence IDs you used. Do not introduce unsupported facts."
NO_EVIDENCE_BLOCK = "(no evidence provided)"
REJECTIONS = ("wrong_label", "missing_citation", "hallucinated_fact", "vague_answer", "wrong_citation", "overclaiming", "insufficient_claim")
REJECTION_TEXTS = {
    "wrong_label": "The decision is inconsistent with the evidence.",
    "missing_citation": "The answer is plausible but omits citations.",
    "hallucinated_fact": "The evidence says the opposite, and this answer adds unsupported details.",
    "vague_answer": "The answer is too vague to be useful.",
    "wrong_citation": "The evidence is cited incorrectly.",
    "overclaiming": "The answer overstates what the evidence proves.",
    "insufficient_claim": "The answer incorrectly claims support despite insufficient evidence.",
    "other": "This answer does not follow the evidence.",
}

# --- fixed values: chat and preference artefacts
CHAT_SYSTEM = (
    "You are a fact-checking assistant. Given a claim and evidence, classify the claim as SUPPORTED, REFUTED, or NOT ENOUGH INFO and explain your "
    "verdict using only the provided evidence, citing evidence ids in brackets."
)
JSON_CHAT_SYSTEM = "You are an evidence-grounded fact verification assistant. Use only the provided evidence. Return a verdict, concise explanation, and citations."
CHAT_TASK = "Classify the claim and explain using only the evidence."
JSON_CHAT_TASK = "Respond with JSON keys verdict, explanation, and citations."
PREFERENCE_FAULTS = ("wrong_verdict", "invalid_citation", "unsupported_explanation")
WRONG_VERDICT = {"SUPPORTED": "REFUTED", "REFUTED": "SUPPORTED", "NOT ENOUGH INFO": "SUPPORTED"}
PAIR_LABELS = {"SUPPORTS": "SUPPORTED", "REFUTES": "REFUTED", "NEI": "NOT_ENOUGH_INFO"}
