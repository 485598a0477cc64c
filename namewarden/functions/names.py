"""Names as columns: words, namespaces, splits, spellings and metadata fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewarden.config import ALIASES, DELIMITERS


def _words(spaced: Column) -> Column:
    return F.filter(F.split(spaced, r"\s+"), lambda x: x != "")


def tokens_served(name: Column) -> Column:
    """Words as names are looked up: lower case, cut at delimiters and behind digits."""
    return _words(F.regexp_replace(F.regexp_replace(F.lower(name), DELIMITERS, " "), "([0-9]+)", "$1 "))


def tokens_trained(name: Column) -> Column:
    """Words as names are trained on: lower case, cut at delimiters and around digits."""
    return _words(F.regexp_replace(F.regexp_replace(F.lower(name), DELIMITERS, " "), "([0-9]+)", " $1 "))


def cleaned(text: Column) -> Column:
    """Lower-case letters and digits, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def pypi_normal(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def by_registry(registry: Column, cases: dict[str, Column]) -> Column:
    out = None
    for r, c in cases.items():
        out = F.when(registry == r, c) if out is None else out.when(registry == r, c)
    return out


def namespace(name: Column, registry: Column) -> Column:
    """npm scope without its sign, maven group of two parts, golang host of more than one, hf author of two; else null."""
    colon, slash = F.split(name, ":"), F.split(name, "/")
    return by_registry(registry, {
        "npm": F.when(name.startswith("@") & (F.size(slash) >= 2), F.substring(F.get(slash, F.lit(0)), 2, 1 << 20)),
        "maven": F.when(F.size(colon) == 2, F.get(colon, F.lit(0))),
        "golang": F.when(F.size(slash) > 1, F.get(slash, F.lit(0))),
        "hf": F.when(F.size(slash) == 2, F.get(slash, F.lit(0))),
    })


def name_parts(name: Column, registry: Column) -> Column:
    """struct(kind, domain, group, package, rest); null where the registry has no parts or the name is malformed."""
    colon, slash = F.split(name, ":"), F.split(name, "/")
    at = lambda a, i: F.get(a, F.lit(i))
    tail = lambda i: F.when(F.size(slash) > i, F.array_join(F.slice(slash, i + 1, 1 << 20), "/"))
    none = F.lit(None).cast("string")

    def made(kind: str, domain: Column, group: Column, package: Column, rest: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), domain.alias("domain"), group.alias("group"), package.alias("package"), rest.alias("rest"))

    group_domain = F.concat_ws(".", F.slice(F.split(at(colon, 0), r"\."), 1, 2))
    github = at(slash, 0) == "github.com"
    return by_registry(registry, {
        "maven": F.when(F.size(colon) == 2, made("maven", group_domain, at(colon, 0), at(colon, 1), none)),
        "golang": F.when(github & (F.size(slash) >= 3), made("github", at(slash, 0), F.lower(at(slash, 1)), at(slash, 2), tail(3))).when(~github & (F.size(slash) >= 2), made("golang", at(slash, 0), none, at(slash, 1), tail(2))),
        "npm": F.when(name.startswith("@") & (F.size(slash) == 2), made("scoped", none, at(slash, 0), at(slash, 1), none)).when(~name.startswith("@"), made("unscoped", none, none, name, none)),
        "hf": F.when(F.size(slash) == 2, made("hf", none, at(slash, 0), at(slash, 1), none)),
    })


def embedding_parts(name: Column, registry: Column) -> Column:
    """struct(namespace, author, package) of what is embedded apart; the last takes what is left of the name. A golang name of one or two parts has its namespace as its author too."""
    colon, slash = F.split(name, ":"), F.split(name, "/")
    at = lambda a, i: F.get(a, F.lit(i))
    rest = lambda i: F.array_join(F.slice(slash, i, 1 << 20), "/")
    empty = F.lit("")

    def made(a: Column, b: Column, c: Column) -> Column:
        return F.struct(a.alias("namespace"), b.alias("author"), c.alias("package"))

    return by_registry(registry, {
        "maven": made(empty, at(colon, 0), F.coalesce(at(colon, 1), empty)),
        "golang": F.when(F.size(slash) >= 3, made(at(slash, 0), at(slash, 1), rest(3))).otherwise(made(at(slash, 0), at(slash, 0), F.coalesce(at(slash, 1), empty))),
        "hf": F.when(F.size(slash) >= 2, made(empty, at(slash, 0), rest(2))).otherwise(made(empty, empty, name)),
    })


def registry_named(text: Column) -> Column:
    """The first registry that a file's name contains, else unknown."""
    out = None
    for r in ("npm", "maven", "pypi", "ruby", "golang", "hf", "nuget"):
        here = F.lower(text).contains(r)
        out = F.when(here, r) if out is None else out.when(here, r)
    return out.otherwise("unknown")


def registry_of(spelling: Column) -> Column:
    """The registry that a spelling stands for."""
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    low = F.lower(F.trim(spelling))
    return F.coalesce(F.create_map(*pairs)[low], low)


def full_name(registry: Column, space: Column, name: Column) -> Column:
    has = space.isNotNull() & (space != "")
    return F.when(has & (registry == "npm"), F.concat(space, F.lit("/"), name)).when(has & (registry == "maven"), F.concat(space, F.lit(":"), name)).otherwise(name)


def purl(registry: Column, space: Column, name: Column) -> Column:
    """A package URL for npm, pypi and ruby; null for others."""
    path = F.when(space.isNotNull() & (space != ""), F.concat(space, F.lit("/"), name)).otherwise(name)
    return F.when(registry == "npm", F.concat(F.lit("pkg:npm/"), path)).when(registry == "pypi", F.concat(F.lit("pkg:pypi/"), name)).when(registry == "ruby", F.concat(F.lit("pkg:gem/"), name))


def json_first(doc: Column, *paths: str) -> Column:
    """The first of the JSON paths that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(doc, p), F.lit("")) for p in paths))


def document_name(doc: Column, registry: Column) -> Column:
    """A document's own name, or where its registry keeps another."""
    return (
        F.when(registry == "maven", json_first(doc, "$.name", "$.doc.name", "$.n", "$.info.name"))
        .when(registry == "nuget", json_first(doc, "$.name"))
        .otherwise(json_first(doc, "$.name", "$.info.name"))
    )


def description(doc: Column, registry: Column) -> Column:
    """The first 100 words of what a document's registry has for a description; empty without.

    npm: description and readme, each behind its heading. pypi and nuget:
    summary and description, if both are there. Others: the readme first.
    """
    of = lambda p: F.coalesce(F.get_json_object(doc, p), F.lit(""))
    filled = lambda *paths: F.concat_ws("\n\n", *(F.nullif(of(p), F.lit("")) for p in paths))
    text = (
        F.when(registry == "npm", F.concat(F.lit("Description:"), of("$.description"), F.lit("\n\nREADME:"), of("$.readme")))
        .when(registry == "pypi", filled("$.info.summary", "$.info.description"))
        .when(registry == "nuget", filled("$.summary", "$.description"))
        .when(registry == "maven", json_first(doc, "$.description", "$.doc.description", "$.d"))
        .otherwise(json_first(doc, "$.readme", "$.description", "$.doc", "$.payload"))
    )
    return F.array_join(F.slice(_words(F.coalesce(text, F.lit(""))), 1, 100), " ")


def maintainers(doc: Column, registry: Column) -> Column:
    """The people that a document of a registry names, in order, empty ones left out."""
    nobody = F.array().cast("array<string>")
    listed = lambda p: F.coalesce(F.from_json(F.get_json_object(doc, p), "array<string>"), nobody)
    fields = lambda p, *names: F.transform(listed(p), lambda x: F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in names)))
    one = lambda p: F.array(F.get_json_object(doc, p))
    owners = F.get_json_object(doc, "$.owners")
    people = (
        F.when(registry == "npm", F.concat(fields("$.maintainers", "name"), one("$.authors.name")))
        .when(registry == "pypi", listed("$.maintainers"))
        .when(registry == "maven", F.concat(fields("$.doc.maintainers", "name"), one("$.doc.a"), one("$.repo_metadata.owner")))
        .when(registry == "nuget", F.when(owners.startswith("["), listed("$.owners")).otherwise(F.array(owners)))
        .otherwise(F.concat(fields("$.maintainers", "login", "uuid"), one("$.repo_metadata.owner")))
    )
    return F.filter(people, lambda x: x.isNotNull() & (x != ""))
