"""What a turn says about the work in hand, as columns: which expressions it fits, and their operands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snagline.functions.exprs import action_key

#: Expressions that a whole turn fits.
STATUS = r"^(?:status(?: update)?|progress(?: update)?|how(?:'s| is) (?:it|the work|the progress)|where (?:are we|does (?:it|this) stand))[?.! ]*$"
STATUS_TARGET = r"^(?:what(?:'s| is) the status of|status of|progress on|any update on) (.+?)[?.! ]*$"
CANCEL = r"^(?:cancel|stop|abandon)(?: this| that| the work| the task| the outcome)?[.! ]*$"
TARGETED_CANCEL = r"^(?:cancel|stop|abandon) (.+?)[.! ]*$"
DONE = r"^(?:this|that|the work|the task|the outcome) is (?:done|complete|finished)[.! ]*$"
REPLACE = r"^(?:instead|replace (?:this|that|the task) with|switch to|change (?:the )?scope to)[: ,]+(.+)$"
RESUME = r"^(?:resume|continue) (?:work on |working on |the |this )?(.+?)[.! ]*$"
APPROVAL = r"^(?:yes[,; ]+)?(?:approved|authorized|go ahead|proceed)(?:[: ,]+)(.+?)[.! ]*$"
QUESTION_ACTION = r"^(?:may|should|can) (?:i|we|you)\s+(.+?)[? ]*$"
DECISION = r"^(?:decision|use|choose|select|the answer is)[: ,]+(.+)$"
EFFECTIVE = r"^instruction effective (\d{4}-\d{2}-\d{2})[: ,]+(.+)$"
#: How advice is asked for, and what restricts, awaits or withholds.
ADVICE = r"^(?:how (?:do|should|could|would)|what (?:is|are|would)|explain|describe|compare|suggest|advise)\b"
RESTRICT = r"\b(?:do not|don't|must not|only|without|except|within|limit(?:ed)? to)\b"
WAIT = r"\b(?:wait for|waiting for|until (?:ci|the build|the test|approval|a response|the provider))\b"
HOLD = r"\b(?:proposal.pending|human approval required|permission hold|approval withheld|do not proceed|only after approval|pending approval)\b"
#: Operands that name nothing, and turns that only go on, agree or refuse.
GENERIC = ("", "work", "task", "it", "this")
GO_ON = ("continue", "resume", "go on")
YES = ("yes", "approved", "go ahead", "proceed")
NO = ("no", "do not proceed", "not approved")
#: What the turns of a work cycle say: a directive (begins so, has both, has none of the last), what stops
#: it, a claim, a challenge, a revision.
DIRECTIVE_BEGINS = r"^\s*(?:please\s+|I want you to\s+|can you\s+)?(?:complete|finish|get|make|implement|build|fix)\b"
DIRECTIVE_WHOLE = r"\b(?:complete|completely|finish)\b"
DIRECTIVE_PROCESS = r"\b(?:workflow|lifecycle|cycle|process)\b"
DIRECTIVE_NOT = r"\b(?:stop|cancel|pause|wait|do not|don't|no changes|only discuss|just explain)\b"
STOPS = r"\b(?:stop|cancel|pause|do not|don't)\b"
CLAIMS = r"\b(?:implemented|deployed|completed)\b"
CHALLENGES = r"\b(?:lessons?|workflow|lifecycle|cycle)\b"
REVISES = (
    r"(?:earlier|previous|prior).{0,120}(?:too broad|incomplete|premature|overstated)"
    r"|(?:production|learning|workflow|cycle).{0,80}(?:still has a gap|not complete|incomplete)"
)
MOST_DIRECTIVE_CHARS = 8_192
#: Characters kept of an objective or an instruction.
KEPT_CHARS = 240
#: Case does not count, classes are Unicode's, only \n ends a line.
_FLAGS = "(?iUd)"


def fits(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_FLAGS + pattern), F.lit(False))


def operand(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of an expression that the text fits, else null."""
    return F.when(fits(text, pattern), F.regexp_extract(text, _FLAGS + pattern, group))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def plain(text: Column) -> Column:
    """Lower case, single spaces, without what ends a sentence; null for null."""
    words = F.regexp_replace(F.regexp_replace(F.lower(stripped(text)), r"(?U)\s+", " "), r"[.!? ]+$", "")
    return F.when(text.isNotNull(), words)


def actions(text: Column) -> Column:
    """Keys of the parts of a request that "and" joins, if each has one; else its own key, if any."""
    parts = F.transform(F.split(stripped(text), r"(?iU)\s+and\s+"), action_key)
    return F.when(F.exists(parts, lambda x: x.isNull()), F.array_compact(F.array(action_key(stripped(text))))).otherwise(parts)


def kept(text: Column) -> Column:
    return F.substring(text, 1, KEPT_CHARS)


def limits(text: Column) -> Column:
    """Facts that a human's words add whatever else they say: (kind, value)."""
    fact = lambda on, kind, value: F.when(on, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    choice = operand(text, DECISION)
    return F.array_compact(F.array(
        fact(fits(text, RESTRICT), "scope_restriction", text), fact(fits(text, HOLD), "permission_hold", text), fact(fits(text, WAIT), "external_wait", text),
        fact(choice.isNotNull(), "settled_decision", kept(choice)),
    ))


def beginning(text: Column) -> Column:
    """What an episode would be that a text begins: its objective, actions, whether it asks for advice, what it approves, its limits."""
    granted = operand(text, APPROVAL)
    wanted = F.coalesce(granted, text)
    return F.struct(
        kept(text).alias("objective"), plain(kept(text)).alias("name"), actions(wanted).alias("keys"), (granted.isNull() & fits(text, ADVICE)).alias("advice"),
        kept(granted).alias("granted"), limits(text).alias("limits"),
    )


def readings(text: Column) -> Column:
    """The ways in which a request may be meant for the episode in hand, the first that holds there counts.

    Each has a code, the operand in plain words and as an action, and what is kept of it.
    """
    none = F.lit(None).cast("string")

    def way(code: str, on: Column, thing: Column = none, value: Column = text) -> Column:
        return F.when(on, F.struct(F.lit(code).alias("code"), plain(thing).alias("thing"), action_key(thing).alias("key"), value.alias("value")))

    found = {p: operand(text, p) for p in (DECISION, STATUS_TARGET, TARGETED_CANCEL, REPLACE, RESUME, APPROVAL)}
    on = {p: x.isNotNull() for p, x in found.items()}
    idle = F.size(actions(text)) == 0
    restrains = fits(text, HOLD) | fits(text, "^" + RESTRICT) | fits(text, "^" + WAIT)
    again = F.coalesce(plain(found[RESUME]).isin(*GENERIC), F.lit(False)) | plain(text).isin(*GO_ON)
    return F.array_compact(F.array(
        way("dated", fits(text, EFFECTIVE), operand(text, EFFECTIVE, 1), kept(operand(text, EFFECTIVE, 2))),
        way("decides", idle & on[DECISION], found[DECISION], kept(found[DECISION])), way("restrains", idle & restrains),
        way("asks", fits(text, STATUS)), way("asks of", on[STATUS_TARGET], found[STATUS_TARGET]),
        way("cancels", fits(text, CANCEL)), way("cancels it", on[TARGETED_CANCEL], found[TARGETED_CANCEL]),
        way("is done", fits(text, DONE)), way("replaces", on[REPLACE], found[REPLACE]), way("resumes", on[RESUME], found[RESUME]),
        way("goes on", again), way("approves", on[APPROVAL], found[APPROVAL]),
    ))


def cycle_code(role: Column, text: Column) -> Column:
    """Bits: directive 1, stop 2, claim 4, challenge 8, revision 16."""
    text, user = F.coalesce(text, F.lit("")), role == "user"
    directs = user & (F.length(text) <= MOST_DIRECTIVE_CHARS) & fits(text, DIRECTIVE_BEGINS) & fits(text, DIRECTIVE_WHOLE) & fits(text, DIRECTIVE_PROCESS) & ~fits(text, DIRECTIVE_NOT)
    bits = (
        (directs, 1), (user & fits(text, STOPS), 2), ((role == "assistant") & fits(text, CLAIMS), 4), (user & fits(text, CHALLENGES), 8),
        ((role == "assistant") & fits(text, f"(?s){REVISES}"), 16),
    )
    return sum((F.when(on, bit).otherwise(0) for on, bit in bits), F.lit(0))
