"""Text expressions: titles, composed descriptions, parsing of checksums and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SUFFIX = r"\((\d{4})\)\s*$"
NO_GENRES = "(no genres listed)"


#: Fields of an item's metadata, whatever it comes from.
METADATA = {
    "title": "string", "release_year": "int", "overview": "string", "genres": "array<string>", "keywords": "array<string>", "poster_path": "string",
    "vote_average": "double", "vote_count": "bigint", "popularity": "double", "runtime": "int", "source": "string",
}
_NAMED = "array<struct<name: string>>"
PAYLOAD = f"""id bigint, title string, original_title string, release_date string, overview string, genres {_NAMED}, keywords struct<keywords: {_NAMED}>,
    poster_path string, vote_average double, vote_count bigint, popularity double, runtime double"""


def nothing() -> Column:
    return F.array().cast("array<string>")


def _names(values: Column) -> Column:
    named = F.filter(F.transform(values, lambda x: x["name"]), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(named, nothing())


def normalized(payload: Column) -> Column:
    """A service's JSON answer as a struct of external_id and METADATA: blank texts and a runtime of 0 are unknown, names are listed where they are given."""
    p = F.from_json(payload, PAYLOAD)
    year, full = F.substring(F.coalesce(p["release_date"], F.lit("")), 1, 4), lambda x: F.nullif(x, F.lit(""))
    fields = {
        "title": F.coalesce(full(p["title"]), p["original_title"]),
        "release_year": F.when(year.rlike("^[0-9]+$"), year).try_cast("int"),
        "overview": full(p["overview"]),
        "genres": _names(p["genres"]),
        "keywords": _names(p["keywords"]["keywords"]),
        "runtime": F.nullif(p["runtime"].cast("int"), F.lit(0)),
        "source": F.lit("service"),
    }
    return F.struct(p["id"].alias("external_id"), *(fields.get(n, p[n] if n in ("poster_path", "vote_average", "vote_count", "popularity") else None).cast(kind).alias(n) for n, kind in METADATA.items()))


def title_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, YEAR_SUFFIX, 1), F.lit("")).cast("int")


def bare_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*" + YEAR_SUFFIX, ""))


def genre_list(genres: Column) -> Column:
    return F.when(genres.isNull() | (genres == NO_GENRES), nothing()).otherwise(F.split(genres, r"\|"))


def _listed(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", "), F.lit(".")))


def described(title: Column, year: Column, overview: Column, genres: Column, keywords: Column) -> Column:
    """"Title (year). Overview Genres: a, b. Keywords: x." without the parts that are missing."""
    head = F.concat(title, F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""), F.lit("."))
    return F.concat_ws(" ", head, F.nullif(F.trim(overview), F.lit("")), _listed("Genres", genres), _listed("Keywords", keywords))


def poster_url(path: Column, base: str) -> Column:
    return F.when(path.isNotNull(), F.concat(F.lit(base), path))


def cleaned(values: Column) -> Column:
    """Trimmed, without empty ones, the first of those that differ in case alone."""
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    known = lambda acc, x: F.exists(acc, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, x: F.when(known(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def checksum(line: Column) -> Column:
    """An MD5 digest in any of the usual notations: bare, before a file name, or after an equals sign."""
    return F.lower(F.nullif(F.regexp_extract(line, r"(?:^|[\s=])([0-9A-Fa-f]{32})(?:\s|$)", 1), F.lit("")))
