"""Character classes, word lists and patterns. They decide the results and must stay as they are."""

#: What str.isspace() accepts below U+3001, for Java regular expressions. Single characters below U+0100 are looked up in a table, and
#: the others are tried only beyond it; a plain list of ranges tries each of them at every character.
WS = r"[\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0[[^\x00-\xff]&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: The same characters.
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_CHAR = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"

TECHNICAL_TERMS = [
    "algorithm", "system", "design", "method", "model", "data", "analysis", "implementation",
    "architecture", "framework", "protocol", "specification", "table", "figure", "research", "study",
    "results", "conclusion", "test", "measurement", "process", "function", "structure", "component",
    "parameter", "variable", "equation", "formula", "calculation",
]
DOMAIN_INDICATORS = [
    "research", "engineering", "development", "technology", "scientific", "technical",
    "academic", "industrial", "analysis", "evaluation", "experiment", "document", "report",
    "paper", "article", "methodology", "technique", "procedure",
]
STRUCTURED_MARKERS = r"(?:Table|Figure|Section|Chapter|Appendix|References?|Fig|Eq|Equation|Page|Vol|Volume|No\.|Number)\s*\d*"
#: The first two letters that a marker can have, so that its words are tried only there.
MARKER_START = "(?=[tfscarepvn][aiehpqou])"
SYMBOL_RUN = r"[^\p{L}\p{N}_\s]{15,}"
#: A character, a backslash and eight or more digits 1, literally.
BACKSLASH_ONES = r"(.)\\1{8,}"
CONSONANT_WORD = r"[bcdfghjklmnpqrstvwxz]{8,}"
REPETITIVE = r"(.{20,}?)\1{4,}"
LOW_INFORMATION = r"^(.{1,10})\1{5,}$"

CATEGORY_WORDS = [
    ("research_data", ["table", "figure", "data", "result", "experiment"]),
    ("academic_paper", ["research", "study", "paper", "journal"]),
    ("technical_document", ["system", "design", "implementation"]),
]
#: Kinds of personal data in the order of their application; \b is replaced by BOUNDARY for Java.
PII = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("CREDIT_CARD", r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
]

#: English stop words, a short list of our own choice.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "between",
    "both", "but", "by", "can", "could", "did", "do", "does", "down", "during", "each", "few", "for", "from", "further", "had", "has",
    "have", "he", "her", "here", "him", "his", "how", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no",
    "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so",
    "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your",
]
