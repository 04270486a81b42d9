"""Taxon lookups, recodes and lumping.

Lookups are left joins against a user-supplied taxonomy.  The taxonomy is
a dimension (one row per taxon), so Spark's size-checked broadcast
(``autoBroadcastJoinThreshold``, and AQE at run time) decides whether it
is shipped to every task; nothing here forces a broadcast of data whose
size is not known.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import grepl, in_set, not_in_set, strict_sum

# Fixed values of the reference: lumping groups and the game-species list.
SCAUP_GROUP = ["GRSC", "LESC", "SCAUP"]
GREBE_GROUP = ["WEGR", "CLGR", "WCGR"]
USELESS_GROUPIES = ["AMCOGRSCLESCBUFF", "COMERBME", "GOOSE", "MERG", "MURRELET", "SWAN", "UNTE", "DUCK"]
USEFUL_GROUPIES = ["LOON", "RTPALO", "CORM", "HEGR", "WCGR", "PCLO"]
# The report's own list adds SCOTER to the useless groups.
USELESS_GROUPIES_REPORT = USELESS_GROUPIES + ["SCOTER"]

# The name fixes applied to a count sheet before translation,
# in order; the regex rule matches as grepl does ("." matches any character).
CBC_NAME_FIXES = [
    ("exact", "Scaup sp.", "Scaup"),
    ("exact", "Scoter sp.", "Scoter"),
    ("regex", "Grebe sp.", "Western/Clark's Grebe"),
    ("exact", "Double-crstd Cormorant", "Double-crested Cormorant"),
    ("exact", "Blk-crowned Night-Heron", "Black-crowned Night-Heron"),
    ("exact", "Pac/Com Loon", "Pacific/Common Loon"),
]


# L1
def attach_taxonomy(df: DataFrame, taxa: DataFrame, fields: Sequence[str] = ("common_name", "species",
                    "species_number"), on: str = "alpha_code", taxa_key: str = "alpha_code") -> DataFrame:
    """Left join of taxonomy fields; unmatched codes keep NULL names."""
    t = taxa.select(F.col(taxa_key).alias("__tk"), *fields)
    return df.join(t, df[on] == t["__tk"], "left").drop("__tk")


# L2
def translate_codes(df: DataFrame, taxa: DataFrame, source: str, target: str, col: str | None = None,
                    name: str | None = None) -> DataFrame:
    """Map ``col`` (values of ``source`` in the taxonomy) to ``target``; no match -> NULL.

    The lookup is made unique on ``source`` first (smallest target wins), so
    the join never multiplies rows.
    """
    col = col or source
    name = name or target
    t = taxa.groupBy(source).agg(F.min(target).alias("__t")).withColumnRenamed(source, "__s")
    out = df.join(t, df[col] == t["__s"], "left").drop("__s")
    return out.withColumnRenamed("__t", name) if name not in df.columns else \
        out.withColumn(name, F.col("__t")).drop("__t")


# F4
def recode_taxa(df: DataFrame, members: Sequence[str], to: str, code: str = "alpha_code") -> DataFrame:
    """Replace member codes by ``to`` in place, without summing."""
    c = F.col(code)
    return df.withColumn(code, F.when(c.isin(list(members)), F.lit(to)).otherwise(c))


# F5
def normalise_names(counts: DataFrame, taxa: DataFrame, season_value: int,
                    fixes: Sequence[tuple] = CBC_NAME_FIXES, name: str = "common_name",
                    count: str = "count") -> DataFrame:
    """Fix names by ordered rules, translate to codes, tag the season, drop NA counts."""
    expr = None
    for kind, pattern, new in fixes:
        cond = (F.col(name) == pattern) if kind == "exact" else grepl(name, pattern)
        expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
    fixed = counts.withColumn(name, expr.otherwise(F.col(name)) if expr is not None else F.col(name))
    coded = translate_codes(fixed, taxa, "common_name", "alpha_code", col=name)
    return (coded.withColumn("season", F.lit(season_value))
            .filter(F.col(count).isNotNull())
            .withColumnRenamed(count, "baywide_count")
            .drop(name))


# F6
def detected_taxa(obs: DataFrame, taxa: DataFrame, code: str = "alpha_code",
                  value: str = "section_final") -> DataFrame:
    """Codes ever counted above zero, with names, in taxonomic order column."""
    codes = obs.filter(F.col(value) > 0).select(F.col(code).alias("species")).distinct()
    named = attach_taxonomy(codes, taxa, ["common_name", "species_number"], on="species")
    return named.select("common_name", "species", "species_number")


# F7
def taxon_list(named_obs: DataFrame, cols: Sequence[str] = ("alpha_code", "common_name", "species")) -> DataFrame:
    return named_obs.select(*cols).distinct()


# A1
def lump_taxa(obs: DataFrame, members: Sequence[str], label: str, tag: str,
              keys: Sequence[str] = ("season", "visit_date", "survey_num", "section"),
              code: str = "alpha_code", value: str = "section_final", data_is: str = "data_is") -> DataFrame:
    """Sum member codes into one ``label`` per key group; other rows unchanged.

    The two branches read the same input with complementary pushed filters;
    only the member rows are shuffled (partial aggregation first).  NULL codes
    are not members and stay (R's ``!x %in% set`` keeps NA).
    """
    cols = [*keys, code, value, data_is]
    lumped = (obs.filter(in_set(code, members)).groupBy(*keys)
              .agg(strict_sum(value).alias(value))
              .withColumn(code, F.lit(label)).withColumn(data_is, F.lit(tag)))
    rest = obs.filter(not_in_set(code, members))
    return lumped.select(*cols).unionByName(rest.select(*cols))


# U8
def new_year_vs_history(history: DataFrame, new_year: DataFrame, codes: Sequence[str] | None = None,
                        code: str = "alpha_code") -> DataFrame:
    """History and the new season's counts, stacked with a source tag."""
    cols = [code, "season", "baywide_count"]
    h = history.select(*cols).withColumn("source", F.lit("history"))
    n = new_year.select(*cols).withColumn("source", F.lit("new"))
    out = h.unionByName(n)
    return out if codes is None else out.filter(in_set(code, codes))
