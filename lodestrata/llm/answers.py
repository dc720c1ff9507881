"""Defects of model answers: empty, truncated, refusal, copy of the query, other language.

``profile_answers`` runs the stack automaton over every whole text once and keeps
a narrow row of findings; ``terminator_baselines`` summarises, per source, how
answers that provably closed ended; ``answer_defects`` and ``truncated_answers``
combine both.  Nulls, empty texts, repeated rows and extra columns are fine: every
input row is judged on its own, an answer that is null or shows nothing is
``empty``, and a null query only switches off the rules that need one.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .answer_structure import Answer, read_answer, requested, shows
from .languages import asked_for, leading, votes

DEFECTS = ("empty", "truncated", "refusal", "copies_query", "other_language")

# Phrases by which a text declines, by language.
REFUSALS = (
    r"\b(?:i|we)(?:'m| am| are|'re)? (?:very |truly |so )?(?:sorry|afraid)\b",
    r"\bi apologi[sz]e\b|\bmy apologies\b|\bunfortunately\b|\bregrettably\b",
    r"\b(?:can(?:no|')t|can not|could not|couldn't|won't|will not|would not|wouldn't|shall not|must not|am not able to|(?:am|are|is|not) unable to|unable to|not able to|not possible|isn't possible|not allowed to|not permitted|not going to|do not feel|don't feel)\b",
    r"\b(?:declin(?:e|ed|ing)|refus(?:e|ed|ing)|pass on|have to pass|must pass|turn (?:this|it) down|not something i|outside (?:of )?what i|beyond what i|against my|conflicts? with|violates?)\b",
    r"\b(?:should|may|can|will|must) not be (?:made|done|written|provided|produced|generated|created|answered|fulfilled)\b",
    r"\bno (?:\w+ ){1,4}(?:will|can) be (?:provided|produced|given|made|written|generated)\b",
    r"\bas an? (?:\w+ ){0,2}(?:assistant|ai|model|language model)\b",
    r"\bleider\b|\btut mir leid\b|\bentschuldig|\bkann (?:ich|dies|das|dabei|hier|ich dir|ich ihnen)?\s*(?:\w+ ){0,6}nicht\b|\bnicht (?:möglich|erlaubt|in der lage|helfen|erfüllen|erstellen|bearbeiten)\b|\bdarf ich nicht\b|\blehne\b.*\bab\b|\babgelehnt\b|\bablehnen\b|\bmuss ich (?:\w+ ){0,4}(?:ablehnen|passen)\b",
    r"\bdésolée?s?\b|\bmalheureusement\b|\bje ne (?:peux|puis|suis|dois|veux)\b|\bne (?:peux|peut|puis|pourrai|saurais) pas\b|\bje (?:refuse|décline|m'excuse|regrette)\b|\bpas en mesure\b|\brefusée?\b|\bdéclinée?\b|\bimpossible de\b",
    r"\blo siento\b|\blamento\b|\bpor desgracia\b|\bdesafortunadamente\b|\blamentablemente\b|\bno (?:puedo|es posible|me es posible|estoy en condiciones|debo|voy a)\b|\bme niego\b|\bdebo (?:rechazar|declinar)\b|\brechazad[ao]\b",
    r"\b(?:desculp|lamento|infelizmente)|\bnão (?:posso|é possível|consigo|devo|vou)\b|\brecuso\b",
    r"\bmi dispiace\b|\bpurtroppo\b|\bmi scuso\b|\bnon (?:posso|è possibile|sono in grado|devo)\b|\brifiuto\b",
    r"\bhelaas\b|\bhet spijt me\b|\bsorry, maar\b|\bkan ik (?:\w+ ){0,4}niet\b|\bniet mogelijk\b",
    r"申し訳|すみません|残念ながら|ごめんなさい|(?:でき|出来|いたし|致し|応じられ|お答えでき|対応でき|作成でき|お手伝いでき|引き受けられ|提供でき)ません|できかね|いたしかね|お断り|辞退|控えさせて",
)
_REFUSAL = re.compile("|".join(REFUSALS), re.I)
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ一-鿿]")
_ESCAPE = re.compile(r"\\[nrt]|\\u[0-9a-fA-F]{4}|&(?:quot|amp|lt|gt|#\d+);")

PROFILE = "complete boolean, reason string, opened string, terminated boolean, last_open boolean, short boolean, closed_kind boolean, chars_per_token double, latin boolean, empty boolean, refusal boolean, copy boolean, copy_cut boolean, other_language boolean"


def _words(text: str) -> list[str]:
    """Lower-case words; scripts without spaces count by character pairs."""
    out: list[str] = []
    for w in _WORD.findall(_ESCAPE.sub(" ", text).lower()):
        if _CJK.search(w):
            out += [w[i : i + 2] for i in range(0, max(len(w) - 1, 1), 2)] if len(w) < 3 else [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


@lru_cache(4096)
def _of_query(query: str) -> tuple[list[str], list[str], set, set]:
    """Words of the instruction line, all words, and the word triples of both."""
    head, q = _words(query.lstrip().split("\n")[0]), _words(query)
    return head, q, _grams(q), _grams(head)


@lru_cache(4096)
def _spoken(query: str) -> frozenset[str]:
    """Languages that a query uses or names; empty where none can be told."""
    lines = query.strip().split("\n")
    if len(lines) > 1:
        spoken = votes(lines[0] + "\n" + lines[-1])
        for k, v in votes("\n".join(lines[1:-1])).items():
            spoken[k] += 0.5 * v
    else:
        spoken = votes(query)
    most = max(spoken.values(), default=0)
    return frozenset({k for k, v in spoken.items() if v >= 0.45 * most and v >= 0.8} | asked_for(lines[0] + "\n" + lines[-1])) if most else frozenset()


_requested = lru_cache(4096)(requested)
_QUOTE_SIGN = re.compile(r"(?m)^[ \t]*>+")
_LOOSE = re.compile(r"\\[nrt]|[\s\"'\\]+")


def _squeezed(text: str) -> str:
    """Lower-case text without white space, quotes, escapes and quotation signs at line starts."""
    return _LOOSE.sub("", _QUOTE_SIGN.sub("", text)).lower()


@lru_cache(4096)
def _own_data(query: str) -> tuple[str, ...]:
    """Neighbouring lines of the data that a query carries, squeezed; empty where it carries none."""
    lines = [x for x in (_squeezed(x) for x in query.strip().split("\n")[1:-1]) if x]
    return tuple(a + b for a, b in zip(lines, lines[1:])) or tuple(lines)


def is_copy(query: str | None, text: str) -> bool:
    """True where the text is the query, or nearly all of it, and nothing else of substance.

    The words of the query's instruction (its first line) must be there in order,
    nearly every word triple of the text must come from the query, data that the
    query carries must stand there in the query's own notation, and the text must
    not go on to a second rendering of it.
    """
    if not query or not text:
        return False
    head, q, gq, gh = _of_query(query)
    low = text.lower()
    if len(q) < 4 or sum(w in low for w in head[:7]) < min(5, len(head)):
        return False
    t = _words(text)
    if len(t) < 0.45 * len(q):
        return False
    gt = _grams(t)
    if not gt or not gq:
        return False
    if gh and len(gh & gt) < 0.7 * len(gh):
        return False
    outside = len(gt - gq)
    if outside > max(8, 0.15 * len(gt)) or len(gt & gq) < 0.6 * len(gq):
        return False
    data = _own_data(query)
    if data:
        whole = _squeezed(text)
        if sum(x in whole for x in data) < 0.5 * len(data):
            return False  # the data is there, but in another notation: a converted answer that repeats the task first
    if len(t) <= 1.35 * len(q) + 8:
        return True
    first = tuple(head[:6])
    again = sum(tuple(t[i : i + 6]) == first for i in range(len(t) - 5))
    return again >= 2 and len(t) <= 1.35 * again * len(q) + 8


def copy_is_cut(query: str, text: str) -> bool:
    """True where a copy stops inside a word or sentence that the query goes on with."""
    tail = text.rstrip("`>\"'} \n\t")
    if tail.endswith((".", "!", "?", "。", ":", "|")) or not tail:
        return False
    q, t = " ".join(query.lower().split()), " ".join(tail.lower().split())[-40:]
    at = q.rfind(t)
    return at >= 0 and bool(q[at + len(t) :].strip()) and (q[at + len(t)].isalnum() and t[-1:].isalnum())


# Letters beyond Latin: such a text is measured in bytes, and against such texts of its source.
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u2c00-\ua71f\uac00-\ud7ff\uf900-\ufaff\uff66-\uffdc]")


def _prose_only(a: Answer) -> str | None:
    """The text of an answer without data, or with nothing but one message in place of it: whole, or cut within its only value."""
    if a.complete is None:
        return "\n".join(a.prose)
    most = 3 if a.complete else 1
    if a.records <= 1 and len(a.values) <= most and len(set(a.keys)) <= most:
        return "\n".join([*a.prose, *a.values])
    return None


def speaks_other(query: str | None, a: Answer, fields: set[str]) -> bool:
    """True where the answer's prose or text values are in a language the query neither uses nor names."""
    if not query:
        return False
    allowed = _spoken(query)
    if not allowed:
        return False
    keys = {k.lower() for k in a.keys}
    lost = a.complete is not None and bool(fields) and len([f for f in fields if f in keys]) < 0.5 * len(fields)
    values = votes("\n".join(a.values))
    for text in (values, values + votes("\n".join(a.prose)) + (votes(" ".join(set(a.keys))) if lost else Counter())):
        lead = leading(text, 1.5, 1.4)
        if lead and lead not in allowed and (a.complete is None or lost or text[lead] >= 4 and text[lead] >= 3 * sum(text[x] for x in allowed)):
            return True
    return False


def profile(query: str | None, text: str | None, output_type: str | None, input_type: str | None, stop: str | None, tokens: float | None) -> tuple:
    """One row of PROFILE."""
    if not shows(text):
        return None, "", "", False, False, False, False, None, True, True, False, False, False, False
    a = read_answer(text, output_type)
    prose = _prose_only(a)
    copy = is_copy(query, text)
    refusal = bool(not copy and prose and _REFUSAL.search(prose))
    rate = None
    latin = text.isascii() or not _OTHER_SCRIPT.search(text)
    if tokens and tokens > 8 and stop != "max_new_tokens":
        rate = (len(text) if latin else len(text.encode("utf-8", "replace"))) / tokens
    if copy:
        return None, "", a.opened, a.terminated, False, False, False, rate, latin, False, False, True, copy_is_cut(query, text), False
    if refusal:
        return None, "", a.opened, a.terminated, False, False, False, rate, latin, False, True, False, False, False
    least, fields = _requested(query, input_type)
    other = speaks_other(query, a, fields)
    short = a.complete is True and a.notation in ("YAML", "TOML", "CSV") and not a.terminated and not other and a.records < least and not (a.prose and a.prose[-1].rstrip().endswith((".", "!", "?", "。")) and a.prose[-1] in text[-len(a.prose[-1]) - 8 :])
    if a.complete and not short and fields and a.notation in ("YAML", "TOML") and a.records == 1 and not a.terminated and not other and len(set(a.keys)) < len(fields):
        short = True
    return a.complete, a.reason, a.opened, a.terminated, a.last_open, short, a.notation in ("JSON", "XML"), rate, latin, False, False, False, False, other


def profile_answers(df: DataFrame, key: str, query: str = "query", text: str = "text", output_type: str = "output_type", input_type: str = "input_type", stop: str = "stop_reason", tokens: str = "generated_tokens", source: str = "export_source") -> DataFrame:
    """One narrow row per input row: ``key``, ``source`` and the columns of PROFILE."""

    def run(batches):
        for b in batches:
            rows = [profile(q, t, o, i, s, None if n is None or n != n else float(n)) for q, t, o, i, s, n in zip(b["q"], b["t"], b["o"], b["i"], b["s"], b["n"])]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])
            out.insert(0, "answer_source", b["source"])
            out.insert(0, "answer_key", b["key"])
            yield out

    narrow = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(query).alias("q"), F.col(text).alias("t"), F.col(output_type).alias("o"), F.col(input_type).alias("i"), F.col(stop).alias("s"), F.col(tokens).cast("double").alias("n"))
    kind = dict(narrow.dtypes)["key"]
    return narrow.mapInPandas(run, f"answer_key {kind}, answer_source string, {PROFILE}")


def terminator_baselines(profiles: DataFrame) -> DataFrame:
    """Per source, over answers that provably closed: share of opened wrappings that ended, and least usual length per token.

    The length is in characters for Latin texts and in bytes for texts with letters of
    other scripts, each with a figure of its own.  One row per source (null is a
    source of its own); a figure is null where a source has no such answer.
    """
    closed = F.col("complete") & F.col("closed_kind")
    return profiles.groupBy(F.col("answer_source").alias("base_source")).agg(
        F.avg(F.when(closed & (F.col("opened") != ""), F.col("terminated").cast("int"))).alias("terminator_rate"),
        F.percentile_approx(F.when(closed & F.col("latin"), F.col("chars_per_token")), 0.01, 1000).alias("least_chars_per_token"),
        F.percentile_approx(F.when(closed & ~F.col("latin"), F.col("chars_per_token")), 0.01, 1000).alias("least_bytes_per_token"),
        F.count(F.when(closed & (F.col("opened") != ""), 1)).alias("closed_answers"),
    )


def _cut(slack: float, sure: float, seen: int) -> Column:
    """Whether a profile joined with its source's baseline is a cut answer."""
    cut_later = F.col("chars_per_token") < slack * F.when(F.col("latin"), F.col("least_chars_per_token")).otherwise(F.col("least_bytes_per_token"))
    no_end = (F.col("opened") != "") & ~F.col("terminated")
    strict = (F.col("terminator_rate") >= sure) & (F.col("closed_answers") >= seen)
    doubtful = F.col("complete") & ~F.col("closed_kind") & F.col("last_open") & ~F.col("terminated")
    return F.coalesce((F.col("complete") == F.lit(False)) | F.col("short") | F.col("copy_cut") | (doubtful & (cut_later | (no_end & strict))), F.lit(False))


def judged(profiles: DataFrame, slack: float = 0.97, sure: float = 0.995, seen: int = 200) -> DataFrame:
    """Profiles with ``truncated``: the automaton's verdict, or an open last value that the source's baseline makes a cut.

    slack: an open last value is a cut where the text has fewer characters per
    generated token than this part of the source's least usual ratio.  sure, seen:
    it is also one where the wrapping has no terminator in a source that ends at
    least this share of at least so many closed answers with one.
    """
    base = terminator_baselines(profiles)
    return profiles.join(base, F.col("answer_source").eqNullSafe(F.col("base_source")), "left").withColumn("truncated", _cut(slack, sure, seen)).drop("base_source")


def truncated_answers(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """Every row of ``df`` with its verdict: ``key``, ``answer_source``, ``truncated``, ``reason`` (null where complete)."""
    j = judged(stage(profile_answers(df, key, **columns), "answers"))
    reason = F.when(F.col("truncated"), F.coalesce(F.nullif("reason", F.lit("")), F.when(F.col("short"), F.lit("missing_records")).otherwise(F.lit("open_last_value"))))
    return j.select(F.col("answer_key").alias(key), "answer_source", "truncated", reason.alias("reason"))


def truncation_by_source(verdicts: DataFrame) -> DataFrame:
    """Rows, cut rows and share of cut rows per source."""
    cut = F.col("truncated").cast("int")
    return verdicts.groupBy("answer_source").agg(F.count("*").alias("answers"), F.sum(cut).cast("long").alias("cut_answers"), F.avg(cut).alias("cut_share"))


def answer_defects(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """(``key``, ``defect``): one row per defect that a row of ``df`` triggers, by the ordered rules of ``profile``."""
    j = judged(stage(profile_answers(df, key, **columns), "answers"))
    found = F.array_compact(
        F.array(
            F.when(F.col("empty"), F.lit("empty")),
            F.when(F.col("copy"), F.lit("copies_query")),
            F.when(F.col("refusal"), F.lit("refusal")),
            F.when(F.col("truncated"), F.lit("truncated")),
            F.when(F.col("other_language"), F.lit("other_language")),
        )
    )
    return j.select(F.col("answer_key").alias(key), F.explode(found).alias("defect"))
