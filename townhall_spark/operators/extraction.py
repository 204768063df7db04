"""Labelled sentences out of transcripts, and prompts for an external model.

Only actions are ever shuffled, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.lexicon import (
    ACTION_TEXT_CHARS,
    LEXICON_VERSION,
    Lexicon,
    labelled_sentences,
)
from townhall_spark.functions.text import sentences, ustrip
from townhall_spark.operators import text_parts
from townhall_spark.schemas import ACTION_CATEGORIES, HAZARD_TYPES

# Fixed value: characters of a transcript that a prompt carries.
PROMPT_CHARS = 6000
# Characters that a prompt shares with the one before.
PROMPT_OVERLAP = 200

_CATEGORIES = {
    "adaptation": "prepares a place for climate harm", "mitigation": "cuts greenhouse-gas emissions",
    "both": "one action that does the two", "unrelated": "anything else"}
_HAZARDS = ", ".join(HAZARD_TYPES)
_KINDS = "\n".join(f"- {name}: {_CATEGORIES[name]}" for name in ACTION_CATEGORIES)

EXTRACTION_PROMPT = f"""You are given part of a transcript of a US local-government meeting.
Find each climate action under discussion and classify it.

Categories:
{_KINDS}
Hazards: {_HAZARDS}.

Answer with one JSON object and nothing else:
{{"actions": [{{"action_text": "...", "action_category": "...", "hazard_type": "...",
"confidence": 0.0}}]}}
Quote action_text word for word. confidence is between 0 and 1. Without any climate
action answer {{"actions": []}}."""

LABEL_PROMPT = f"""Reply with a JSON object of three fields about the passage below:
"action_category", one of the categories; "hazard_type", one of the hazards; and
"confidence", a number from 0 to 1.

Categories:
{_KINDS}
Hazards: {_HAZARDS}.

Passage:
"""


def split_sentences(rows: DataFrame, keep: list[str], text: str = "transcript") -> DataFrame:
    """(keep..., pos, sentence): one row per counted sentence, ``pos`` from 0."""
    return rows.select(*keep, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def extract_actions(rows: DataFrame, lexicon: Lexicon, version: str = LEXICON_VERSION,
                    text: str = "transcript", stamped: bool = True,
                    max_chars: int = ACTION_TEXT_CHARS) -> DataFrame:
    """One action per sentence the lexicon does not call ``unrelated``.

    ``rows`` are the records of meetings. Records of a meeting with the same stripped
    text count once: their actions are equal, and equal actions meet by meeting,
    text digest and position, so that texts themselves are never shuffled or
    gathered. Sentences do not cross records. The sentence is classified whole;
    ``action_text`` keeps its first ``max_chars`` characters. The whole decision runs
    inside the exploded array; a filter outside it would be pushed down and classify
    every sentence a second time.
    """
    out = (rows.select("canonical_id", F.md5(ustrip(F.col(text))).alias("_text"),
                       F.explode(labelled_sentences(F.col(text), lexicon)).alias("a"))
           .select("canonical_id", "_text", F.col("a.pos").alias("_pos"),
                   F.substring("a.text", 1, max_chars).alias("action_text"),
                   F.col("a.label.category").alias("action_category"),
                   F.col("a.label.hazard").alias("hazard_type"),
                   F.col("a.label.confidence").alias("confidence"))
           .distinct().drop("_text", "_pos")
           .withColumn("model_version", F.lit(version)))
    return out.withColumn("extracted_at", F.current_timestamp()) if stamped else out


def model_version(provider: str, model: str) -> str:
    """Stamp of actions that a model produced."""
    return f"{provider}:{model}"


def prompt_windows(parts: DataFrame, prompt: str = EXTRACTION_PROMPT,
                   max_chars: int = PROMPT_CHARS, overlap: int = PROMPT_OVERLAP) -> DataFrame:
    """(canonical_id, window_seq, prompt): windows that cover a transcript from end to end.

    ``parts`` are the transcript's, in order. A window holds ``max_chars`` characters
    and starts ``overlap`` before the end of the one before, so that no sentence shorter
    than that is only seen in halves.
    """
    return text_parts.windows(parts, ["canonical_id"], max_chars, overlap).select(
        "canonical_id", "window_seq",
        F.concat(F.lit(f"{prompt}\n\n## Transcript excerpt\n\n"), "excerpt", F.lit("\n"))
        .alias("prompt"))


def prompt_table(transcripts: DataFrame, prompt: str = EXTRACTION_PROMPT,
                 max_chars: int = PROMPT_CHARS, overlap: int = PROMPT_OVERLAP) -> DataFrame:
    """:func:`prompt_windows` of transcripts (canonical_id, transcript) that are one text each."""
    return prompt_windows(text_parts.whole(transcripts, ["canonical_id"]), prompt, max_chars,
                          overlap)


def label_prompts(rows: DataFrame, keep: list[str], text: str = "action_text",
                  max_chars: int = PROMPT_CHARS, overlap: int = PROMPT_OVERLAP) -> DataFrame:
    """(keep..., window_seq, prompt): prompts that ask a model to label an excerpt, windows
    over the whole of a long one. ``keep`` tells the rows apart."""
    return text_parts.windows(text_parts.whole(rows, keep, text), keep, max_chars, overlap).select(
        *keep, "window_seq", F.concat(F.lit(LABEL_PROMPT), "excerpt").alias("prompt"))


def label_prompt(text: Column, max_chars: int = PROMPT_CHARS) -> Column:
    """Prompt that asks a model to label one excerpt; a longer one is an error, as it needs
    :func:`label_prompts`."""
    return F.when(F.length(text) > max_chars, F.raise_error(F.lit(
        f"an excerpt has more than {max_chars} characters"))).otherwise(
        F.concat(F.lit(LABEL_PROMPT), text))
