"""Free-text notes: keyword search, note parts, per-date digests and the
hunter-presence comparison (SURVEY §2.9 X1-X6, A27, A28).

Whole note texts are processed.  Keyword filters run before the distinct
(the predicate depends only on the grouping columns, so Catalyst pushes it
below the aggregate), so only matching notes are shuffled.  Where all notes
count (lowered notes, X2, X3) they are told apart by 128-bit digests and texts
are not shuffled (``sources.placed``): these write their notes once when called.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import grepl, in_set, natural_join, paste, strict_sum
from ..sources import joined_text
from ..sources.placed import distinct_by_digest

# The reference's block-note search terms, in its order.
BLOCK_NOTE_TERMS = ["not", "hunt", "keep data", "jk", "review", "proportion", "poor", "coverage", "verified",
                    "hard", "missing", "data", "fog", "incomplete", "count", "duck", "waterfowl", "flew",
                    "goose", "added", "shot"]

# The game species codes of the hunter-presence check.
GAME_SPECIES = ["AMCO", "AMWI", "BAGO", "BRAN", "BUFF", "CACG", "CAGO", "CANV", "CITE", "COGO", "COMO", "DUCK",
                "EUWI", "GADW", "GRSC", "GWFG", "GWTE", "HOME", "LESC", "MALL", "NOPI", "NOSH", "REHE", "RNDU",
                "RUDU", "SCAUP", "WODU"]


def terms_pattern(terms: Sequence[str], pad: bool = True) -> str:
    """The search pattern.  ``pad=True`` keeps the reference's joining with
    ``" | "``, so inner terms need a space on both sides, the first only
    after and the last only before; ``pad=False`` is plain alternation."""
    return (" | " if pad else "|").join(terms)


def lowered_notes(notes: DataFrame, date: str = "visit_date", block: str = "block",
                  text: str = "block_notes") -> DataFrame:
    """Distinct non-missing block notes, lower-cased."""
    d = distinct_by_digest(notes.filter(F.col(text).isNotNull()), [date, block], text)
    return d.withColumn(text, F.lower(F.col(text)))


# X1
def keyword_notes(notes: DataFrame, terms: Sequence[str] = BLOCK_NOTE_TERMS, pad: bool = True,
                  date: str = "visit_date", block: str = "block", text: str = "block_notes") -> DataFrame:
    """Lower-cased block notes matching any term, with a "block: note" label."""
    pattern = terms_pattern(terms, pad)
    d = notes.select(date, block, text).distinct().filter(F.col(text).isNotNull())
    hit = d.withColumn(text, F.lower(F.col(text))).filter(grepl(text, pattern))
    return hit.withColumn("block_w_notes", paste(block, text, sep=": "))


# X2
def survey_notes_lower(notes: DataFrame, date: str = "visit_date", text: str = "survey_notes") -> DataFrame:
    """Distinct non-missing survey notes per date, lower-cased, prefixed "all survey: "."""
    d = distinct_by_digest(notes.filter(F.col(text).isNotNull()), [date], text)
    return d.withColumn(text, paste(F.lit("all survey: "), F.lower(F.col(text)), sep=" "))


# X3
def numeric_note_parts(notes: DataFrame, parts: int | None = None, date: str = "visit_date", block: str = "block",
                       text: str = "block_notes") -> DataFrame:
    """Notes holding a digit, split on "," or "." (into the first ``parts`` pieces, if given),
    one row per non-empty piece (pieces are not trimmed)."""
    d = distinct_by_digest(notes.filter(grepl(text, "\\d")), [date, block], text)
    pieces = F.split(F.col(text), ",|\\.")
    if parts is not None:
        pieces = F.slice(pieces, 1, parts)
    e = d.select(date, block, text, F.explode(pieces).alias("extract_notes"))
    return e.filter(F.col("extract_notes").isNotNull() & (F.col("extract_notes") != ""))


# X4
def hunter_presence(lowered: DataFrame, word: str = "hunt", date: str = "visit_date", block: str = "block",
                    text: str = "block_notes") -> DataFrame:
    """(date, block) with a note that mentions ``word``: one row each, and the number of such notes."""
    hit = lowered.filter(grepl(text, word))
    return hit.groupBy(date, block).agg(F.count(F.lit(1)).alias("n_notes")).withColumn("hunters", F.lit(True))


# X5
def with_hunters(counts: DataFrame, hunt: DataFrame, game: Sequence[str] = GAME_SPECIES,
                 date: str = "visit_date", block: str = "block", species: str = "species") -> DataFrame:
    """Counts of blocks that ever had hunters, labelled by presence and game status.

    Same rows as a full join on (date, block) restricted to hunted blocks,
    computed as: counts semi-joined to the (small) set of hunted blocks, left
    join to the hunted (date, block) pairs, plus pairs that matched no count.
    A pair is one row however many notes it has, so no count is repeated;
    ``n_notes`` (NULL without hunters) keeps their number as a weight.
    """
    blocks = hunt.select(block).distinct()
    c = natural_join(counts, blocks, [block], "left_semi")
    left = natural_join(c, hunt, [date, block], "left")
    seen = c.select(date, block).distinct()
    only_hunt = natural_join(hunt, seen, [date, block], "left_anti")
    for f in counts.schema.fields:
        if f.name not in only_hunt.columns:
            only_hunt = only_hunt.withColumn(f.name, F.lit(None).cast(f.dataType))
    j = left.unionByName(only_hunt.select(*left.columns))
    return (j.withColumn("hunters", F.when(F.col("hunters").isNull(), "hunters not present")
                         .otherwise("hunters present"))
            .withColumn("game_spp", F.when(in_set(species, game), "game species").otherwise("non-game species")))


# A28
def presence_effect(labelled: DataFrame, date: str = "visit_date", block: str = "block",
                    count: str = "count") -> DataFrame:
    """Block totals by presence and game status, then mean, sd, n and standard error."""
    t = (labelled.groupBy(date, "hunters", "game_spp", block).agg(strict_sum(count).alias("sum_count"))
         .filter(F.col("sum_count").isNotNull()))
    g = t.groupBy("hunters", "game_spp").agg(F.avg("sum_count").alias("mean_count"),
                                             F.stddev_samp("sum_count").alias("sd_count"),
                                             F.count(F.lit(1)).alias("num_rec"))
    return g.withColumn("st_err", F.col("sd_count") / F.sqrt(F.col("num_rec")))


# A27
def notes_per_date(block_hits: DataFrame, survey: DataFrame, date: str = "visit_date") -> DataFrame:
    """All notes of a date, one row each: ``src`` 0 keyword block notes, 1 survey notes.

    (date, src, notes) is the reading order; sort by it at a sink.  Notes are
    never gathered into one value, so a date may have any number of them.
    """
    b = block_hits.select(date, F.lit(0).alias("src"), F.col("block_w_notes").alias("notes"))
    s = survey.select(date, F.lit(1).alias("src"), F.col("survey_notes").alias("notes"))
    return b.unionByName(s)


def notes_text_per_date(block_hits: DataFrame, survey: DataFrame, path: str, date: str = "visit_date") -> DataFrame:
    """A date's notes as one text, ``" | "`` between them: block notes first, then survey notes.

    The notes are written under ``path`` in that order and read back (see
    ``sources.joined_text``): ``all_date_notes`` of each date.
    """
    notes = notes_per_date(block_hits, survey, date)
    joined_text.write_joined(notes, path, date, ["src"], "notes")
    return joined_text.read_joined(notes.sparkSession, path, date, notes.schema[date].dataType.simpleString(),
                                   "all_date_notes")


# X6
def missed_with_notes(status_matrix: DataFrame, notes: DataFrame, date: str = "visit_date") -> DataFrame:
    """Status table and the notes of its date side by side (full join on date), date first.

    With ``notes_per_date`` a row per note, with ``notes_text_per_date`` a row per date.
    """
    j = natural_join(status_matrix, notes, [date], "full")
    return j.select(date, *[c for c in j.columns if c != date])
