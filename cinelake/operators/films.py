"""Film records: local groups of files, matches with an external catalogue, merged films, aliases and the review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions import tokens as T
from cinelake.functions.text import casefold, normalize_alias, or_empty, title_similarity
from cinelake.operators.groups import LIST, joined_lists, medians

_NAMED = "array<struct<name:string>>"
SEARCH = "struct<results:array<struct<id:long,title:string,original_title:string,release_date:string>>>"
DETAILS = (
    "struct<id:long,title:string,original_title:string,original_language:string,release_date:string,runtime:double,"
    f"genres:{_NAMED},production_companies:{_NAMED},production_countries:array<struct<iso_3166_1:string,name:string>>,"
    "alternative_titles:struct<titles:array<struct<title:string,iso_3166_1:string>>>,external_ids:struct<imdb_id:string>,"
    "credits:struct<crew:array<struct<job:string,name:string>>>>"
)


def skip_reason(title: Column, filename: Column, normalized: Column, standard: Column) -> Column:
    """TV_EPISODE, UNPARSED, or null for a file that belongs to a film."""
    named = F.coalesce(F.nullif(title, F.lit("")), filename)
    return F.when(named.rlike(T.EPISODE), "TV_EPISODE").when((standard == "UNPARSED") | (F.trim(normalized) == ""), "UNPARSED")


def local_id(title: Column, year: Column) -> Column:
    return F.concat(F.lit("LOCAL-"), F.upper(F.substring(F.sha1(F.concat(title, F.lit("|"), year)), 1, 12)))


def film_files(records: DataFrame) -> DataFrame:
    """Rows of files that belong to films, with the normal title and the year of their group: norm, year."""
    d = records.where(skip_reason(F.col("filename_title"), F.col("filename"), F.col("normalized_title"), F.col("filename_standard")).isNull())
    return d.withColumns({"norm": F.trim("normalized_title"), "year": or_empty(F.col("filename_year"))})


def local_groups(records: DataFrame) -> DataFrame:
    """A row per (normal title, year) of files that belong to films: local_id, title, normalized_title, year, runtime_min,
    n_files, files, aliases, first_ord.

    The title is the most frequent one, then the shortest, then the first by case-folded text, then the first seen.
    Aliases are all titles and the title tags of two characters or more, sorted by case-folded text. The running time is
    the median of the known ones in minutes. Titles are counted per group first, so a group's rows are never gathered to
    pick one; nor are they for the median or for files, the paths in the listing's order, joined by newlines and cut as
    ``joined_lists`` says. Aliases, of which a group has as many as different titles, are a list.
    """
    d = film_files(records).select(
        "norm", "year", F.trim("filename_title").alias("title"), F.trim("title_tag").alias("tag"), (F.when(F.col("duration_sec") > 0, F.col("duration_sec")) / 60.0).alias("minutes"), "path", "ord",
    )
    by = ["norm", "year"]
    titles = d.where("title <> ''").groupBy(*by, "title").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    titles = titles.withColumn("fold", casefold("title"))
    best = titles.groupBy(*by).agg(F.min_by("title", F.struct(-F.col("n"), F.length("title"), "fold", "first")).alias("best"))
    names = d.select(*by, F.col("title").alias("alias")).unionByName(d.where(F.length("tag") >= 2).select(*by, F.col("tag").alias("alias"))).where("alias <> ''").distinct()
    names = names.withColumn("fold", casefold("alias")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("fold", "alias"))).alias("names"))
    core = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.min("ord").alias("first_ord"))
    out = core.join(best, by, "left").join(names, by, "left").join(medians(d, by, "minutes"), by, "left").join(joined_lists(d, by, "path", "ord"), by, "left")
    return out.select(
        local_id(F.col("norm"), F.col("year")).alias("local_id"),
        F.coalesce("best", "norm").alias("title"),
        F.col("norm").alias("normalized_title"),
        "year",
        F.bround("median", 1).alias("runtime_min"),
        "n_files",
        or_empty(F.col("list")).alias("files"),
        F.coalesce(F.col("names.alias"), F.array().cast("array<string>")).alias("aliases"),
        "first_ord",
    )


def year_of(date: Column) -> Column:
    return F.regexp_extract(or_empty(date), r"^(\d{4})", 1).try_cast("int")


def year_score(local: Column, date: Column) -> Column:
    gap = F.abs(local.try_cast("int") - year_of(date))
    fits = F.when(gap == 0, 100.0).when(gap == 1, 80.0).when(gap == 2, 50.0).otherwise(0.0)
    return F.when(~local.rlike(r"^\p{Nd}+$"), 50.0).when(year_of(date).isNull(), 35.0).otherwise(fits)


def runtime_score(local: Column, candidate: Column) -> Column:
    gap = F.abs(local - candidate)
    fits = F.when(gap <= 2, 100.0).when(gap <= 5, 85.0).when(gap <= 10, 60.0).when(gap <= 20, 25.0).otherwise(0.0)
    return F.when(local.isNull() | (F.coalesce(candidate, F.lit(0)) == 0), 50.0).otherwise(fits)


def total_score(title: Column, year: Column, language: Column, countries: Column, runtime: Column) -> Column:
    """Weighted sum of the components, half-even to one decimal. language and countries (array) are the candidate's."""
    spoken = F.when(F.lower(or_empty(language)) == "th", 100.0).otherwise(20.0)
    made = F.when(F.array_contains(countries, "TH"), 100.0).when(F.size(countries) <= 0, 35.0).otherwise(10.0)
    return F.bround(title * 0.55 + year * 0.15 + spoken * 0.10 + made * 0.10 + runtime * 0.10, 1)


def rank_candidates(groups: DataFrame, searches: DataFrame, most: int = 3, first: int = 10) -> DataFrame:
    """The ``most`` best of the first ``first`` search results of each group by title and year alone: local_id, id, prelim.

    searches: local_id, response (JSON text). Ties keep the results' order. Results without an id leave after the cut.
    """
    most = min(max(most, 1), 5)
    d = groups.select("local_id", "title", "year").join(searches.select("local_id", F.from_json("response", SEARCH).alias("s")), "local_id")
    d = d.select("local_id", F.col("title").alias("own"), "year", F.posexplode("s.results").alias("pos", "c")).where(F.col("pos") < first)
    near = F.greatest(title_similarity("own", or_empty(F.col("c.title"))), title_similarity("own", or_empty(F.col("c.original_title"))))
    d = d.select("local_id", F.col("c.id").alias("id"), "pos", (near * 0.8 + year_score(F.col("year"), F.col("c.release_date")) * 0.2).alias("_score"))
    d = d.withColumn("prelim", F.row_number().over(W.partitionBy("local_id").orderBy(F.desc("_score"), "pos")))
    return d.where((F.col("prelim") <= most) & (F.coalesce("id", F.lit(0)) != 0)).select("local_id", "id", "prelim")


def external_aliases(details: Column) -> Column:
    """Titles of a catalogue entry as (title, source, country), in order, blanks left out (see distinct_aliases)."""
    row = lambda t, s, c: F.struct(F.trim(or_empty(t)).alias("title"), F.lit(s).alias("source"), or_empty(c).alias("country"))
    more = F.transform(F.coalesce(details["alternative_titles"]["titles"], F.array().cast("array<struct<title:string,iso_3166_1:string>>")), lambda x: row(x["title"], "TMDb alternative title", x["iso_3166_1"]))
    every = F.concat(F.array(row(details["title"], "TMDb title", F.lit("")), row(details["original_title"], "TMDb original title", F.lit(""))), more)
    return F.filter(every, lambda x: x["title"] != "")


def distinct_aliases(entries: DataFrame, keys: list[str], details: str) -> DataFrame:
    """keys, pos, a (title, source, country), norm: the first title of each normal form, source and country of an entry."""
    every = entries.select(*keys, F.posexplode(external_aliases(F.col(details))).alias("pos", "a")).withColumn("norm", normalize_alias(F.col("a.title")))
    first = every.groupBy(*keys, "norm", F.col("a.source").alias("s"), F.col("a.country").alias("c")).agg(F.min(F.struct("pos", "a")).alias("m"))
    return first.select(*keys, "m.pos", "m.a", "norm")


def score_candidates(groups: DataFrame, ranked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Scored candidates: local_id, rank, d (details), score, title_score, best_alias, year_score, runtime_score.

    catalogue: id, response (JSON text). The best alias is the first with the highest similarity to the group's title.
    """
    d = ranked.join(catalogue.select("id", F.from_json("response", DETAILS).alias("d")), "id").join(groups.select("local_id", "title", "year", "runtime_min"), "local_id")
    names = distinct_aliases(d, ["local_id", "id", "title"], "d")
    names = names.withColumn("_sim", title_similarity("title", F.col("a.title")))
    best = names.groupBy("local_id", "id").agg(F.max_by(F.struct("_sim", F.col("a.title").alias("t")), F.struct("_sim", -F.col("pos"))).alias("b"))
    d = d.join(best, ["local_id", "id"], "left")
    countries = F.transform(F.coalesce(F.col("d.production_countries"), F.array().cast("array<struct<iso_3166_1:string,name:string>>")), lambda x: F.upper(or_empty(x["iso_3166_1"])))
    d = d.withColumns(
        {
            "title_score": F.coalesce(F.col("b._sim"), F.lit(0.0)),
            "best_alias": or_empty(F.col("b.t")),
            "year_score": year_score(F.col("year"), F.col("d.release_date")),
            "runtime_score": runtime_score(F.col("runtime_min"), F.col("d.runtime")),
        }
    )
    d = d.withColumn("score", total_score(F.col("title_score"), F.col("year_score"), F.col("d.original_language"), countries, F.col("runtime_score")))
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("local_id").orderBy(F.desc("score"), "prelim")))
    return d.select("local_id", "rank", "d", "score", "title_score", "best_alias", "year_score", "runtime_score")


def is_confident(score: Column, margin: Column, title: Column, year: Column, known_year: Column, least: float = 90.0, apart: float = 8.0) -> Column:
    return (score >= least) & (margin >= apart) & (title >= 88.0) & ((known_year == "") | (year >= 80.0))


def decide(groups: DataFrame, searches: DataFrame, scored: DataFrame, least: float = 90.0, apart: float = 8.0) -> DataFrame:
    """A match per group: status (HIGH_CONFIDENCE, REVIEW, NO_MATCH, ERROR), confidence, margin, notes, top (details).

    A search row whose ``error`` is not empty is an ERROR. A single candidate's margin is its score."""
    top = scored.groupBy("local_id").agg(
        F.min_by(F.struct("d", "score", "title_score", "best_alias", "year_score"), "rank").alias("t"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    failed = or_empty(F.col("error")) if "error" in searches.columns else F.lit("")
    found = F.from_json("response", SEARCH)["results"]
    d = groups.select("local_id", "year").join(searches.select("local_id", failed.alias("failed"), (F.coalesce(F.size(found), F.lit(0)) > 0).alias("some")), "local_id", "left").join(top, "local_id", "left")
    margin = F.bround(F.col("t.score") - F.coalesce("second", F.lit(0.0)), 1)
    sure = is_confident(F.col("t.score"), margin, F.col("t.title_score"), F.col("t.year_score"), F.col("year"), least, apart)
    status = F.when(or_empty(F.col("failed")) != "", "ERROR").when(F.col("t").isNull(), "NO_MATCH").when(sure, "HIGH_CONFIDENCE").otherwise("REVIEW")
    empty = F.when(F.coalesce("some", F.lit(False)), "TMDb candidates could not be enriched").otherwise("TMDb search returned no candidates")
    notes = F.when(status == "ERROR", F.col("failed")).when(status == "NO_MATCH", empty).otherwise(F.concat(F.lit("best alias: "), F.col("t.best_alias"), F.format_string("; margin: %.1f", margin)))
    return d.select("local_id", status.alias("status"), F.col("t.score").alias("confidence"), margin.alias("margin"), notes.alias("notes"), F.col("t.d").alias("top"))


def not_run(groups: DataFrame) -> DataFrame:
    """The match of every group when no catalogue is configured."""
    return groups.select("local_id", F.lit("NOT_RUN").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("margin"), F.lit("").alias("notes"), F.from_json(F.lit("null"), DETAILS).alias("top"))


def no_candidates(spark: SparkSession) -> DataFrame:
    """Scored candidates where there are none."""
    return spark.createDataFrame([], f"local_id string, rank int, d {DETAILS}, score double, title_score double, best_alias string, year_score double, runtime_score double")


def _listed(names: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != ""), ", ")


def film_records(groups: DataFrame, matches: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """films, aliases, enrichment (by path) of groups, their matches and the records that the groups are of.

    Groups that match the same catalogue entry with high confidence become one film; its facts come from its first member
    (by normal title and year). External aliases are added unless a local one has the same normal form. Local titles stay.
    """
    m = groups.join(matches, "local_id").withColumn("key", F.when((F.col("status") == "HIGH_CONFIDENCE") & F.col("top.id").isNotNull(), F.concat(F.lit("TMDB-"), F.col("top.id"))).otherwise(F.col("local_id")))
    order = F.struct("normalized_title", "year")
    films = m.groupBy("key").agg(
        F.min_by(F.struct("title", "year", "runtime_min", "status", "confidence", "margin", "top"), order).alias("p"),
        F.sum("n_files").alias("_n_files"),
        F.array_sort(F.collect_list(F.struct("normalized_title", "year", "local_id", "n_files", "files", "aliases"))).alias("members"),
    )
    accepted = F.col("key").startswith("TMDB-")
    top, p = F.col("p.top"), F.col("p")
    when = lambda c: F.when(accepted, or_empty(c.cast("string"))).otherwise("")
    films = films.withColumn("_aliases", F.array_distinct(F.flatten("members.aliases")))
    local = films.select("key", accepted.alias("ok"), F.col("p.top.id").alias("id"), F.explode("_aliases").alias("alias")).withColumns({"norm": normalize_alias("alias"), "fold": casefold("alias")})
    outer = distinct_aliases(films.where(accepted).select("key", F.col("p.top.id").alias("id"), top.alias("top")), ["key", "id"], "top")
    outer = outer.join(local.select("key", "norm").distinct(), ["key", "norm"], "left_anti")
    outer = outer.withColumn("_first", F.row_number().over(W.partitionBy("key", "norm").orderBy("pos"))).where("_first = 1")
    row = lambda k, i, a, s, c, t: [k.alias("Film Record ID"), i.alias("TMDb ID"), a.alias("Alias"), s.alias("Alias Source"), c.alias("Country"), t.alias("Status")]
    aliases = local.select(*row(F.col("key"), F.when(F.col("ok"), F.col("id")), F.col("alias"), F.lit("Local filename/title tag"), F.lit(""), F.lit("LOCAL")))
    aliases = aliases.unionByName(outer.select(*row(F.col("key"), F.col("id"), F.col("a.title"), F.col("a.source"), F.col("a.country"), F.lit("TMDB"))))
    count = local.select("key", "norm").unionByName(outer.select("key", "norm")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    crew = F.transform(F.filter(F.coalesce(top["credits"]["crew"], F.array().cast("array<struct<job:string,name:string>>")), lambda x: F.lower(x["job"]) == "director"), lambda x: F.trim(or_empty(x["name"])))
    countries = F.transform(top["production_countries"], lambda x: F.coalesce(F.nullif(x["iso_3166_1"], F.lit("")), x["name"], F.lit("")))
    ran = p["status"] != "NOT_RUN"
    canonical = F.when(accepted, or_empty(top["title"])).otherwise(p["title"])
    thai = F.when(accepted & (top["original_language"] == "th"), or_empty(top["original_title"])).otherwise("")
    joined = films.join(count, "key", "left")
    table = joined.select(
        F.col("key").alias("Film Record ID"),
        F.array_join("members.local_id", ", ").alias("Local Group IDs"),
        canonical.alias("Canonical Title"),
        thai.alias("Original Thai Title"),
        F.when(accepted, F.coalesce(year_of(top["release_date"]).cast("string"), p["year"])).otherwise(p["year"]).alias("Year"),
        F.when(accepted, top["id"]).alias("TMDb ID"),
        when(top["external_ids"]["imdb_id"]).alias("IMDb ID"),
        F.when(F.size("members") > 1, "HIGH_CONFIDENCE / MERGED").otherwise(p["status"]).alias("Match Status"),
        F.when(ran, p["confidence"]).alias("Match Confidence"),
        F.when(ran, p["margin"]).alias("Match Margin"),
        F.when(accepted, top["runtime"]).otherwise(p["runtime_min"]).alias("Runtime min"),
        when(_listed(top["genres"]["name"])).alias("Genres"),
        when(F.array_join(F.array_distinct(F.filter(crew, lambda x: x != "")), ", ")).alias("Director"),
        when(_listed(top["production_companies"]["name"])).alias("Production Companies"),
        when(F.array_join(countries, ", ")).alias("Production Countries"),
        F.col("_n_files").alias("Files"),
        F.coalesce("_n", F.lit(0)).alias("Aliases"),
        F.substring(F.array_join("members.files", "\n"), 1, LIST).alias("Paths"),
    )
    own = films.select("key", canonical.alias("canonical_title"), thai.alias("original_thai_title"), F.when(accepted, top["id"]).alias("tmdb_id"), when(top["external_ids"]["imdb_id"]).alias("imdb_id"))
    of = m.select("local_id", "key", F.col("status").alias("tmdb_match_status"), F.when(F.col("status") != "NOT_RUN", F.col("confidence")).alias("tmdb_match_confidence"))
    files = film_files(records).select("path", local_id(F.col("norm"), F.col("year")).alias("local_id")).join(of, "local_id")
    enrichment = files.join(own, "key").select("path", F.col("key").alias("film_record_id"), "canonical_title", "original_thai_title", "tmdb_id", "imdb_id", "tmdb_match_status", "tmdb_match_confidence")
    return {"films": table, "aliases": aliases, "enrichment": enrichment.dropDuplicates(["path"])}


def skipped_enrichment(records: DataFrame) -> DataFrame:
    """Enrichment rows of files that belong to no film."""
    why = skip_reason(F.col("filename_title"), F.col("filename"), F.col("normalized_title"), F.col("filename_standard"))
    blank = lambda n: F.lit("").alias(n)
    return records.where(why.isNotNull()).select(
        "path", blank("film_record_id"), blank("canonical_title"), blank("original_thai_title"), F.lit(None).cast("long").alias("tmdb_id"), blank("imdb_id"),
        F.concat(F.lit("SKIPPED_"), why).alias("tmdb_match_status"), F.lit(None).cast("double").alias("tmdb_match_confidence"),
    ).dropDuplicates(["path"])


def review_rows(groups: DataFrame, matches: DataFrame, scored: DataFrame) -> DataFrame:
    """Every candidate of the groups whose match needs a look, or one row without a candidate; notes stand on rank 1."""
    d = matches.where(F.col("status").isin("REVIEW", "NO_MATCH", "ERROR")).join(groups.select("local_id", "title", "year", "runtime_min"), "local_id").join(scored, "local_id", "left")
    c, none = F.col("d"), F.col("rank").isNull()
    return d.select(
        F.col("local_id").alias("Local Group ID"), F.col("title").alias("Filename Title"), F.col("year").alias("Year"), F.col("runtime_min").alias("Local Runtime min"),
        F.col("status").alias("Status"), F.col("rank").alias("Candidate Rank"), F.nullif(c["id"], F.lit(0)).alias("TMDb ID"), or_empty(c["title"]).alias("Candidate Title"),
        or_empty(c["original_title"]).alias("Original Title"), or_empty(c["release_date"]).alias("Release Date"), or_empty(c["original_language"]).alias("Original Language"),
        F.nullif(c["runtime"], F.lit(0.0)).alias("Candidate Runtime"), F.col("score").alias("Score"), F.col("title_score").alias("Title Score"), or_empty(F.col("best_alias")).alias("Best Alias"),
        F.col("year_score").alias("Year Score"), F.col("runtime_score").alias("Runtime Score"), F.when(none | (F.col("rank") == 1), F.col("notes")).otherwise("").alias("Notes"),
    )
