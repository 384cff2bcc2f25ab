"""Text functions, each from columns to a column, so that all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Patterns and replacements of the redaction, applied in this order.
REDACTIONS = [
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/]+=*", "$1[REDACTED]"),
    (r"""(?i)(api[_\-]?key|apikey|access[_\-]?key|secret[_\-]?key|auth[_\-]?token|auth[_\-]?secret)\s*[=:]\s*["']?([A-Za-z0-9\-._~+/]{16,})["']?""", "$1=[REDACTED]"),
    (r"""(?i)(password|passwd|pwd)\s*[=:]\s*["']?([^\s"']{4,})["']?""", "$1=[REDACTED]"),
    (r"(?i)(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^:\s@/]+:[^@\s/]+@", "$1://[CREDENTIALS_REDACTED]@"),
    (r"(?s)-----BEGIN (?:(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY)-----.*?-----END (?:(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY)-----", "[PRIVATE KEY REDACTED]"),
    (r"\b(AKIA|ASIA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b", "[AWS_KEY_REDACTED]"),
    (r"""(?i)(token|jwt|client[_\-]?secret|app[_\-]?secret|private[_\-]?key|encryption[_\-]?key)\s*[=:]\s*["']?([A-Za-z0-9+/=\-_]{32,})["']?""", "$1=[REDACTED]"),
]

#: What a plan request's words are that say nothing of its subject.
STOP_WORDS = ["add", "adjust", "and", "change", "create", "delete", "feature", "fix", "for", "from", "implement", "in", "make", "modify", "of", "remove", "rename", "the", "this", "to", "update", "with"]


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(text: str | Column) -> Column:
    """Lower case for A to Z only: bytes above 127 stay as they are."""
    return F.translate(col(text), _UPPER, _LOWER)


def folded(text: str) -> str:
    """The same for a literal."""
    return text.translate(str.maketrans(_UPPER, _LOWER))


def redact(text: str | Column) -> Column:
    """The text with credentials replaced. One cheap scan lets clean texts through untouched."""
    text = found = col(text)
    for pattern, by in REDACTIONS:
        found = F.regexp_replace(found, pattern, by)
    hint = r"(?i)bearer|key|auth|pass|pwd|://|AKIA|ASIA|AROA|AIPA|ANPA|ANVA|token|jwt|secret"
    return F.when(F.rlike(text, F.lit(hint)), found).otherwise(text)


def tokens(text: str | Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(col(text)) / 4)).cast("int")


def snippet(text: str | Column, limit: int) -> Column:
    return F.substring(redact(text), 1, limit)


def line_end_trimmed(text: str | Column) -> Column:
    """Without white space at its end, in the Unicode sense and with the separators 28 to 31."""
    return F.regexp_replace(col(text), r"(?U)[\s\x1c-\x1f\x85]+$", "")


def is_natural_language(query: str | Column) -> Column:
    """Two words or more, of letters only."""
    return F.rlike(F.trim(col(query)), F.lit(r"^\p{L}+(?:\s+\p{L}+)+$"))


def digest_id(prefix: str, *parts: str | Column) -> Column:
    """prefix, a colon and 24 hex digits of the SHA-256 over the parts, which char 31 joins; null counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 24))


def query_terms(request: str | Column, limit: int = 8) -> Column:
    """Search terms of a request: words with an underscore, a dot or an inner capital in their order, then all of three
    letters or more by length (longest first) and name; the whole request if that leaves none."""
    request = col(request)
    words = F.filter(F.regexp_extract_all(request, F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)), lambda w: ~F.lower(w).isin(STOP_WORDS))
    coded = F.filter(words, lambda w: F.rlike(w, F.lit(r"[_.]|.[A-Z]")))
    long = F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w, i: F.struct((-F.length(w)).alias("n"), F.lower(w).alias("l"), i.alias("i"), w.alias("w")))
    found = F.array_distinct(F.concat(coded, F.transform(F.array_sort(long), lambda x: x["w"])))
    return F.when(F.size(found) > 0, F.slice(found, 1, limit)).otherwise(F.array(request))
