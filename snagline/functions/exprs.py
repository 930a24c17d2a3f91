"""Scalar expressions as columns; none of them leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_CHARS = 240
STAMP = "yyyy-MM-dd HH:mm:ss"


def present(column: str | Column) -> Column:
    """Not null and not blank; like trim(), blank means spaces."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & (F.trim(column) != "")


def in_window(ts: str, start: str, end: str | None = None) -> Column:
    """Half-open: start <= ts < end; no end means no upper bound."""
    inside = F.col(ts) >= F.lit(start).cast("timestamp")
    return inside & (F.col(ts) < F.lit(end).cast("timestamp")) if end else inside


def key_of(prefix: str, *parts: str | Column) -> Column:
    """prefix and parts joined by colons, cut to the length of a key."""
    return F.substring(F.concat_ws(":", F.lit(prefix), *parts), 1, KEY_CHARS)


def hashed_key(key: Column) -> Column:
    """A key that is too long keeps its head and gets a digest, so that keys stay apart."""
    digest = F.substring(F.sha2(key, 256), 1, 32)
    return F.when(F.length(key) > KEY_CHARS, F.concat(F.substring(key, 1, KEY_CHARS - 33), F.lit(":"), digest)).otherwise(key)


def fingerprint12(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 12)


def iso_week(ts: str | Column) -> Column:
    """YYYY-Www of ISO 8601."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    year = F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def stamp(ts: str | Column) -> Column:
    return F.date_format(ts, STAMP)


def priority(sessions: str, events: str, last_seen: str, now: str, window_days: int) -> Column:
    """4 log(1+sessions) + log(1+events) + a recency that halves with each window; none for no timestamp."""
    seconds = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(last_seen))
    age = F.greatest(F.lit(0.0), seconds / 86_400_000_000)
    recency = F.coalesce(F.pow(F.lit(2.0), -age / window_days), F.lit(0.0))
    return 4 * F.log1p(F.col(sessions)) + F.log1p(F.col(events)) + recency


def known_amount(column: str) -> Column:
    """Null unless finite and not negative."""
    c = F.col(column)
    return F.when((c >= 0) & ~F.isnan(c) & (c != float("inf")), c)


#: What is masked in an error text, in this order.
SIGNATURE_STEPS = (
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?i)\b(?:[0-9a-f]{40}|[0-9a-f]{64})\b", "<sha>"),
    (r"(?i)\b0x[0-9a-f]+\b", "<hex>"),
    (r"(?i)\b[0-9a-f]{7,64}\b", "<hex>"),
    (r"(?i)/(?:home|tmp|var|Users)/[^\s:'\"]+", "<path>"),
    (r"(?<![A-Za-z0-9_/])/(?:[A-Za-z0-9._@+-]+/)*[A-Za-z0-9._@+-]+", "<path>"),
    (
        r"(^|[\s(\"'=,:])(?:(?:\./|\.\./)[A-Za-z0-9._@+-]+(?:/[A-Za-z0-9._@+-]+)*"
        r"|(?:[A-Za-z0-9._@+-]+/)+[A-Za-z0-9._@+-]*[._0-9-][A-Za-z0-9._@+-]*)",
        "$1<path>",
    ),
    (r"\b\d+\b", "<n>"),
    (r"\s+", " "),
)

#: Credential shapes and what stands for them, in this order.
CREDENTIALS = (
    (r"(?i)\bgh[pousr]_[A-Za-z0-9_-]{12,}", "<redacted:github-token>"),
    (r"(?i)\bgithub_pat_[A-Za-z0-9_]{12,}", "<redacted:github-token>"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "<redacted:aws-access-key>"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer <redacted:bearer-token>"),
    (
        r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt])|(?<=%[0-9A-Fa-f]{2}))(?=[A-Za-z0-9_.=-]{40,}(?<!\.)(?![A-Za-z0-9_=-]))"
        r"eyJ[A-Za-z0-9_-]*={0,2}\.[A-Za-z0-9_-]+={0,2}\.[A-Za-z0-9_-]+={0,2}(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])",
        "<redacted:jwt>",
    ),
    (r"(?i)\bsk-[A-Za-z0-9_-]{12,}", "<redacted:api-key>"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "<redacted:slack-token>"),
    (
        r"\b(?:hvs\.[A-Za-z0-9_-]{90,120}|hvb\.[A-Za-z0-9_-]{138,300}|s\.[A-Za-z0-9]{24})(?![A-Za-z0-9_-])",
        "<redacted:vault-token>",
    ),
    (
        r"(?i)(\b_forward_auth_csrf['\"]?\s*[:=]\s*)(['\"]?)[a-f0-9]{32}(?![A-Za-z0-9_-])",
        "$1$2<redacted:csrf-token>",
    ),
    (r"(?s)-{5}BEGIN [A-Z ]+ PRIVATE KEY-{5}.*?-{5}END [A-Z ]+ PRIVATE KEY-{5}", "<redacted:private-key>"),
    (
        r"(?i)(\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|(?:secret|access|private)[_-]?key"
        r"|refresh[_-]?token|password|secret|token)['\"]?\s*[:=]\s*)(['\"]?)[^\s,'\"]+",
        "$1$2<redacted:secret>",
    ),
)
#: For each credential shape, in lower case, one of which a text must have; see redacted().
_HEADS = (
    ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("akia", "asia"), ("bearer",), ("eyj",), ("sk-",), ("xox",), ("hvs.", "hvb.", "s."),
    ("_forward_auth_csrf",), ("-----begin",), ("key", "token", "secret", "password"),
)
#: Letters outside ASCII that match an ASCII one when case does not count.
_ALIKE = "\u017f\u0130\u0131\u212a"
SIGNATURE_INPUT = 400


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        # Python's classes are Unicode, Java's only with this flag
        text = F.regexp_replace(text, f"(?U){pattern}", replacement)
    return text


def _step(pattern: str, replacement: str, heads: tuple[str, ...]) -> Callable[[Column], Column]:
    def step(text: Column) -> Column:
        lower, may = F.lower(text), F.lit(False)
        for head in heads:
            may = may | F.contains(lower, F.lit(head))
        for letter in _ALIKE:
            may = may | F.contains(text, F.lit(letter))
        return F.when(may, _replaced(text, ((pattern, replacement),))).otherwise(text)

    return step


def redacted(text: Column) -> Column:
    """Credentials replaced by what they are; redaction comes before any cut.

    An expression only reads texts that have one of its heads, which a plain
    search finds.  Each step takes the text of the one before as a variable, so
    that it is computed once.
    """
    now = F.array(text)
    for (pattern, replacement), heads in zip(CREDENTIALS, _HEADS):
        now = F.transform(now, _step(pattern, replacement, heads))
    return F.trim(F.replace(F.get(now, F.lit(0)), F.lit("\0"), F.lit("")))


def signature(text: Column) -> Column:
    """An error text without its volatile values."""
    return F.trim(_replaced(F.substring(F.trim(redacted(text)), 1, SIGNATURE_INPUT), SIGNATURE_STEPS))


def exit_code(text: Column) -> Column:
    """The number of a leading `Exit code N` line, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^Exit code (\d{1,9})(?:\n|$)", 1), F.lit("")), F.lit("999999999")).cast("int")


def program(signature_text: Column, command: Column) -> Column:
    """`X: command not found` names X; else the first word of the command that assigns nothing."""
    named = F.nullif(F.regexp_extract(signature_text, r"(?:^|\s)([^\s:]+): command not found", 1), F.lit(""))
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: ~F.contains(w, F.lit("=")))
    return F.substring_index(F.coalesce(named, F.get(words, F.lit(0))), "/", -1)


#: What an intervention says, first match first.
INTERVENTIONS = (
    ("cancellation", r"\b(?:stop|cancel|pause|abort|hold off|never mind|do not continue|don't continue)\b"),
    (
        "correction",
        r"\b(?:actually|instead|incorrect|wrong|mistake|you missed|you forgot|that's not|that is not|I meant|I asked"
        r"|don't ask|do not ask|why did you|you should have|not what I)\b",
    ),
    (
        "scope_change",
        r"\b(?:also (?:add|include|handle|support)|change (?:the )?scope|expand|only (?:change|edit|fix|do|touch)"
        r"|leave .{0,60} alone)\b",
    ),
    (
        "preference",
        r"\b(?:I prefer|I'd prefer|I would prefer|going forward|from now on|always|never|please use"
        r"|keep .{0,40} concise|avoid|rather than)\b",
    ),
    ("approval", r"\b(?:approved|approve|go ahead|yes|proceed|continue|sounds good|do it|ship it)\b"),
    (
        "redirection",
        r"\b(?:focus on|switch to|use .{0,50} instead|first .{0,80} then|can you (?:check|look|try)"
        r"|please (?:check|look|try))\b",
    ),
)
#: What makes a turn a question, and an ordinary request.
QUESTION = r"\b(?:why|what|how|where|when|can you|could you)\b"
ORDINARY = r"^(?:new (?:task|request)|next (?:task|project)|build |create |implement |write )"


#: Java's own word bounds look at letters of all scripts or of ASCII only, by its version.
_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: What is read otherwise: word bounds, and the two letters that have a third form when case does not count.
_PORTED = {r"\b": _BOUND, "s": "[sſ]", "k": "[k\u212a]"}


def portable(pattern: str) -> str:
    """A pattern without character classes and capital S and K, read by Java as RE2 reads it: words are ASCII, case folds in Unicode."""
    return re.sub(r"\\.|[sk]", lambda m: _PORTED.get(m[0], m[0]), pattern)


#: Characters of Unicode's class of spaces.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def intervention(text: Column, first: Column) -> Column:
    """Category of a human turn; nothing precedes the first turn of a session."""
    text = F.trim(text, F.lit(_SPACES))
    found = F.when(first, "task_start")
    for name, pattern in INTERVENTIONS:
        found = found.when(text.rlike(f"(?is){portable(pattern)}"), name)
    found = found.when(F.contains(text, F.lit("?")) | text.rlike(f"(?i){portable(QUESTION)}"), "question")
    return found.when(text.rlike(f"(?i){portable(ORDINARY)}"), "ordinary_request").otherwise("ambiguous")


#: The verbs an action begins with.
VERBS = "implement|build|fix|write|create|update|deploy|test|review|prepare|finish|publish|remove|delete|migrate"


def action_key(text: Column) -> Column:
    """`verb:object` of a request, else null; the object in lower case with single spaces."""
    pattern = rf"(?i)^(?:please )?({VERBS})\s+(.+?)[.! ]*$"
    text = F.trim(text)
    thing = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 2)), r"\s+", " ")
    key = F.concat(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(":"), F.regexp_replace(thing, r"[.!? ]+$", ""))
    return F.when(text.rlike(pattern), key)
