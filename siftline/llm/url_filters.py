"""URL filters by a tree of path templates for each host.

Native steps parse urls, replace digits in path segments and count the resulting
shapes.  Level by level, children that hold a small share of their parent become
a wildcard, so that a host has few templates however many paths it has.  A small
table of templates is then merged host by host, where sibling branches look
alike in structure and in labels.  A template is rejected if its share of blocked
urls is high, smoothed towards the same template's share in its zone (the last
part of the host), which is smoothed towards its share in all zones; so labels
reach the templates of hosts that have none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import durable


@dataclass(frozen=True)
class Rule:
    """A host and all its subdomains, a path prefix, and what happens to urls that fit; the longest rule wins."""

    verdict: str
    host: str
    prefix: str

    @property
    def name(self) -> str:
        return self.host + self.prefix


def rules_from_text(text: str) -> list[Rule]:
    """Rules written as ``allow com/`` or ``block net/es/``, separated by commas."""
    out = []
    for item in text.split(","):
        verdict, name = item.split()
        host, slash, rest = name.partition("/")
        out.append(Rule(verdict, host, slash + rest))
    return out


RULES = rules_from_text("allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host up to /, ? or #, with A-Z lower-cased, and the path up to ? or #."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.prefix)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


@dataclass(frozen=True)
class Settings:
    """``least_share``: of its parent's urls or labels, for a segment to stay, and ``least_of_host``: of its host's, which
    bounds the templates of a host; ``strength`` and ``prior``: of the smoothing; ``reject``: purity from which a template
    is blocked; ``alike``: standard errors within which two branches' shares of blocked labels count as the same;
    ``rest``: shapes with deeper segments from which on a level is no longer a round of Spark's."""

    least_share: float = 0.05
    least_of_host: float = 0.001
    strength: float = 4.0
    prior: float = 0.3
    reject: float = 0.5
    alike: float = 1.64
    rest: int = 100_000


def shape(path: Column) -> Column:
    """The path with every run of digits as ``0``, and long hexadecimal runs with digits as ``0`` too."""
    plain = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f-]*[0-9])[0-9A-Fa-f][0-9A-Fa-f-]{15,}(?![0-9A-Za-z])", "0")
    return F.regexp_replace(plain, r"[0-9]+", "0")


def _stays(n, known, all_n, all_known, host_n, host_known, settings: Settings):
    """Whether a segment stays (columns or numbers): it has enough of its parent's urls, or of the labels, if it has some
    and not all of the parent's urls are labelled."""
    many = (n >= settings.least_share * all_n) & (n >= settings.least_of_host * host_n)
    stands_out = (known >= settings.strength) & (known >= settings.least_share * all_known) & (known >= settings.least_of_host * host_known) & (all_known < all_n)
    return many | stands_out


def _deeper(group: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """All further levels below one template of a host."""
    host_n, host_known = group["host_n"].iloc[0], group["host_known"].iloc[0]
    rows = [(list(s), n, k) for s, n, k in zip(group["_segments"], group["n"].tolist(), group["known"].tolist(), strict=True)]
    out = [""] * len(rows)
    open_ = [(int(group["level"].iloc[0]), list(range(len(rows))))]
    while open_:
        level, held = open_.pop()
        below: dict[str, list[int]] = {}
        for i in held:
            if len(rows[i][0]) > level:
                below.setdefault(rows[i][0][level], []).append(i)
        total, known = (sum(rows[i][c] for x in below.values() for i in x) for c in (1, 2))
        branches: dict[str, list[int]] = {}
        for segment, own in below.items():
            keep = _stays(sum(rows[i][1] for i in own), sum(rows[i][2] for i in own), total, known, host_n, host_known, settings)
            branches.setdefault(segment if keep else "*", []).extend(own)
        for segment, own in branches.items():
            for i in own:
                out[i] += "/" + segment
            open_.append((level + 1, own))
    return pd.DataFrame({"host": group["host"], "shape": group["shape"], "template": group["template"] + out})


def _generalised(shapes: DataFrame, settings: Settings) -> DataFrame:
    """Add ``template``: segments whose share of their parent's urls is small become ``*``, from the root down.

    Each level is two aggregations and two joins on keys, which Spark can split where a host holds most shapes; only
    shapes with deeper segments go on.  Once these are few, the rest of their levels is worked out template by template.
    """
    known = F.col("bad") + F.col("good")
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum(known).alias("host_known"))
    segments = F.split(F.regexp_replace("shape", "^/", ""), "/")
    now = durable(shapes.join(hosts, "host").select("host", "shape", "n", known.alias("known"), "host_n", "host_known", segments.alias("_segments"), F.lit("").alias("template")))
    done, level = [], 0
    while True:
        done.append(now.where(F.size("_segments") <= level).select("host", "shape", "template"))
        now = now.where(F.size("_segments") > level)
        left = now.count()
        if left <= settings.rest:
            break
        placed = now.withColumn("_here", F.element_at("_segments", level + 1))
        children = placed.groupBy("host", "template", "_here").agg(F.sum("n").alias("_n"), F.sum("known").alias("_known"), F.first("host_n").alias("_host_n"), F.first("host_known").alias("_host_known"))
        parents = children.groupBy("host", "template").agg(F.sum("_n").alias("_all"), F.sum("_known").alias("_all_known"))
        stays = _stays(*(F.col(c) for c in ("_n", "_known", "_all", "_all_known", "_host_n", "_host_known")), settings)
        kept = children.join(parents, ["host", "template"]).where(stays).select("host", "template", "_here", F.lit(True).alias("_kept"))
        joined = placed.join(kept, ["host", "template", "_here"], "left")
        step = F.when(F.col("_kept"), F.concat(F.lit("/"), "_here")).otherwise(F.lit("/*"))
        now = durable(joined.withColumn("template", F.concat("template", step)).drop("_kept", "_here"))
        level += 1
    if left:
        done.append(now.withColumn("level", F.lit(level)).groupBy("host", "template").applyInPandas(lambda g: _deeper(g, settings), "host string, shape string, template string"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return durable(shapes.join(out, ["host", "shape"]))


def _expected(templates: DataFrame, settings: Settings) -> DataFrame:
    """Add ``expected`` to the templates of hosts: what the same template's labels elsewhere say.

    Each zone with labels is one observation of a template, beside the prior; a zone's own labels are smoothed towards
    their mean.
    """
    zone = F.substring_index("host", ".", -1)
    zones = templates.groupBy(zone.alias("zone"), "template").agg(F.sum("bad").alias("zone_bad"), F.sum(F.col("bad") + F.col("good")).alias("zone_known")).where("zone_known > 0")
    all_zones = zones.groupBy("template").agg(((F.sum(F.col("zone_bad") / F.col("zone_known")) + settings.prior) / (F.count("*") + 1)).alias("everywhere"))
    out = templates.withColumn("zone", zone).join(zones, ["zone", "template"], "left").join(all_zones, "template", "left")
    everywhere = F.coalesce("everywhere", F.lit(settings.prior))
    here = (F.coalesce("zone_bad", F.lit(0)) + settings.strength * everywhere) / (F.coalesce("zone_known", F.lit(0)) + settings.strength)
    return out.select("host", "template", "n", "bad", "good", here.alias("expected"))


def _merged(group: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Merge the branches of one host's tree and judge the templates."""
    group = group.sort_values("template")
    rows = [[t.split("/")[1:], int(n), int(bad), int(good), t, float(e)] for t, n, bad, good, e in zip(*(group[c] for c in ("template", "n", "bad", "good", "expected")), strict=True)]
    for level in range(max((len(r[0]) for r in rows), default=0)):
        parents: dict[tuple, dict[str, list]] = {}
        for r in rows:
            if len(r[0]) > level:
                parents.setdefault(tuple(r[0][:level]), {}).setdefault(r[0][level], []).append(r)
        for children in parents.values():
            pools: list[dict] = []
            for name in sorted(children):
                below = {tuple(r[0][level + 1 :]) for r in children[name]}
                bad, good = sum(r[2] for r in children[name]), sum(r[3] for r in children[name])
                for p in pools:
                    overlap = len(below & p["below"]) / len(below | p["below"])
                    if bad + good and p["bad"] + p["good"] and overlap >= 0.5:
                        share = (bad + p["bad"]) / (bad + good + p["bad"] + p["good"])
                        error = math.sqrt(share * (1 - share) * (1 / (bad + good) + 1 / (p["bad"] + p["good"])))
                        if abs(bad / (bad + good) - p["bad"] / (p["bad"] + p["good"])) <= settings.alike * error + 1e-12:
                            p["names"].append(name)
                            p["below"] |= below
                            p["bad"], p["good"] = p["bad"] + bad, p["good"] + good
                            break
                else:
                    pools.append({"names": [name], "below": below, "bad": bad, "good": good})
            for p in pools:
                if len(p["names"]) > 1:
                    label = "{" + "|".join(p["names"]) + "}"
                    for name in p["names"]:
                        for r in children[name]:
                            r[0] = [*r[0][:level], label, *r[0][level + 1 :]]
    total: dict[tuple, list] = {}
    for r in rows:
        t = total.setdefault(tuple(r[0]), [0, 0, 0, 0.0])
        t[0], t[1], t[2], t[3] = t[0] + r[1], t[1] + r[2], t[2] + r[3], t[3] + r[1] * r[5]
    # without any label of its own a template follows the others; else its urls without one speak against it
    purity = {k: (bad + settings.strength * e / n) / ((n if bad + good else 0) + settings.strength) for k, (n, bad, good, e) in total.items()}
    return pd.DataFrame({"host": group["host"].iloc[0], "template": [r[4] for r in rows], "merged": ["/" + "/".join(r[0]) for r in rows], "purity": [purity[tuple(r[0])] for r in rows]})


def url_verdicts(df: DataFrame, key: str = "page_id", url: str = "url", rules: list[Rule] | None = None, label: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row for each input row: key, host, path, rule, verdict (allow or block), template and purity.

    A rule decides the urls that it fits; the rest follow their template: blocked if its smoothed purity, the share of
    blocked labels among all of its urls, is at least ``settings.reject``.  Labels are the rules' own verdicts, or those of the column
    ``label`` where that is given and not null.  A template without labels has the purity that its zone and all zones
    give it, and the prior where no host has a label for it.

    Null urls and urls without ``://`` have an empty host and path.  Repeated rows, null keys and ties are kept; other
    columns are not read.  Paths may have any depth.  A host that holds most rows is counted before it is shuffled, its
    templates are bounded by ``settings.least_of_host``, and rows find their template by a join that Spark can split.
    No rows in, none out.
    """
    host, path = host_and_path(F.col("_url"))
    given = F.col(label) if label else F.lit(None).cast("string")
    parsed = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), given.alias("_given")).withColumns({"host": host, "path": path})
    name, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = parsed.withColumns({"rule": name, "_ruled": verdict, "shape": shape(F.col("path"))}).withColumn("_label", F.coalesce("_given", "_ruled"))
    shapes = judged.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("_label") == "block").alias("bad"), F.count_if(F.col("_label") == "allow").alias("good"))
    known = _generalised(shapes, settings)
    templates = known.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tree = _expected(durable(templates), settings).groupBy("host").applyInPandas(lambda g: _merged(g, settings), "host string, template string, merged string, purity double")
    lookup = known.join(tree, ["host", "template"]).select("host", "shape", F.col("merged").alias("template"), "purity")
    out = judged.join(lookup, ["host", "shape"], "left")
    by_tree = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_ruled", by_tree).alias("verdict"), "template", "purity")
