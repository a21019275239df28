"""The template tree against a plain version that holds every url, and what it decides on the given pages."""

import random
import re
from collections import defaultdict

import pytest

from siftline.llm import url_filters

S = url_filters.Settings()


def plain_shape(path):
    path = re.sub(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f-]*[0-9])[0-9A-Fa-f][0-9A-Fa-f-]{15,}(?![0-9A-Za-z])", "0", path)
    return re.sub(r"[0-9]+", "0", path)


def plain_tree(urls, settings=S):
    """(template, purity) of each (host, path, label or None), url by url."""
    segments = [plain_shape(p).removeprefix("/").split("/") for _, p, _ in urls]
    template = [""] * len(urls)
    hosts = defaultdict(list)
    for i, (h, _, _) in enumerate(urls):
        hosts[h].append(i)
    for own in hosts.values():
        host_n, host_known = len(own), sum(urls[i][2] is not None for i in own)
        for level in range(max(len(segments[i]) for i in own)):
            parents = defaultdict(list)
            for i in own:
                if len(segments[i]) > level:
                    parents[template[i]].append(i)
            for parent, below in parents.items():
                known = [i for i in below if urls[i][2] is not None]
                children = defaultdict(list)
                for i in below:
                    children[segments[i][level]].append(i)
                for name, part in children.items():
                    labels = sum(urls[i][2] is not None for i in part)
                    many = len(part) >= settings.least_share * len(below) and len(part) >= settings.least_of_host * host_n
                    stands = labels >= settings.strength and labels >= settings.least_share * len(known) and labels >= settings.least_of_host * host_known and len(known) < len(below)
                    for i in part:
                        template[i] = parent + "/" + (name if many or stands else "*")
    zones = defaultdict(list)
    for i, (h, _, label) in enumerate(urls):
        if label is not None:
            zones[h.rsplit(".", 1)[-1], template[i]].append(label == "block")

    def expected(host, t):
        shares = [sum(x) / len(x) for (_, u), x in zones.items() if u == t]
        everywhere = (sum(shares) + settings.prior) / (len(shares) + 1)
        own = zones.get((host.rsplit(".", 1)[-1], t), [])
        return (sum(own) + settings.strength * everywhere) / (len(own) + settings.strength)

    out = [None] * len(urls)
    for host, own in hosts.items():
        name = {i: template[i].split("/")[1:] for i in own}
        for level in range(max(len(x) for x in name.values())):
            parents = defaultdict(lambda: defaultdict(list))
            for i in own:
                if len(name[i]) > level:
                    parents[tuple(name[i][:level])][name[i][level]].append(i)
            for children in parents.values():
                pools = []
                for child in sorted(children):
                    part = children[child]
                    below = {tuple(name[i][level + 1 :]) for i in part}
                    for p in pools:
                        a, b = ([urls[i][2] == "block" for i in x if urls[i][2] is not None] for x in (part, p["rows"]))
                        if a and b and len(below & p["below"]) >= 0.5 * len(below | p["below"]):
                            share = (sum(a) + sum(b)) / (len(a) + len(b))
                            error = (share * (1 - share) * (1 / len(a) + 1 / len(b))) ** 0.5
                            if abs(sum(a) / len(a) - sum(b) / len(b)) <= settings.alike * error + 1e-12:
                                p["names"].append(child), p["rows"].extend(part)
                                p["below"] |= below
                                break
                    else:
                        pools.append({"names": [child], "rows": list(part), "below": below})
                for p in pools:
                    if len(p["names"]) > 1:
                        for i in p["rows"]:
                            name[i] = [*name[i][:level], "{" + "|".join(p["names"]) + "}", *name[i][level + 1 :]]
        merged = defaultdict(list)
        for i in own:
            merged[tuple(name[i])].append(i)
        for key, part in merged.items():
            labels = [urls[i][2] == "block" for i in part if urls[i][2] is not None]
            mean = sum(expected(host, template[i]) for i in part) / len(part)
            purity = (sum(labels) + settings.strength * mean) / ((len(part) if labels else 0) + settings.strength)
            for i in part:
                out[i] = ("/" + "/".join(key), purity)
    return out


@pytest.mark.parametrize("rest", [0, 30, 100_000])
def test_tree_equals_the_plain_version(spark, rest):
    rng = random.Random(rest)
    rows = []
    for _ in range(900):
        host = rng.choice(["a.com", "b.com", "c.net", "d.org"])
        path = "/" + "/".join(rng.choice(["x", "y", "z", f"p{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}", str(rng.randrange(99))]) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 7])))
        chance = {"x": 0.9, "y": 0.1}.get(path.split("/")[1], 0.5)
        label = None if rng.random() < 0.5 or host == "d.org" else "block" if rng.random() < chance else "allow"
        rows.append((host, path, label))
    rows += [("e.org", "", None), ("e.org", "/deep" * 60, None)]
    df = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, (h, p, x) in enumerate(rows)], "page_id long, url string, label string")
    out = {r["page_id"]: r for r in url_filters.url_verdicts(df, rules=[], label="label", settings=url_filters.Settings(rest=rest)).collect()}
    for i, (template, purity) in enumerate(plain_tree(rows)):
        assert out[i]["template"] == template and abs(out[i]["purity"] - purity) < 1e-9
        assert out[i]["verdict"] == ("block" if out[i]["purity"] >= S.reject else "allow")
    assert len({r["verdict"] for r in out.values()}) == 2


def test_labels_reach_the_pages_that_no_rule_fits(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = [r for r in url_filters.url_verdicts(df).collect() if r["rule"] is None]
    assert out and {r["verdict"] for r in out} == {"allow", "block"}
    # what com/ allows everywhere is allowed in zones without labels, and what example.com/en/ blocks is blocked there
    by = {(r["host"].rsplit(".", 1)[-1], r["path"].split("/")[1]): r["verdict"] for r in out}
    assert by["org", "de"] == by["net", "de"] == "allow" and by["org", "en"] == by["net", "en"] == "block"


def test_awkward_urls(spark):
    long = "http://h.org/" + "a" * 200_000 + "/" + "/b" * 3_000
    rows = [(1, long), (2, long), (None, None), (3, "://"), (4, "x://?"), (4, "x://?")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filters.url_verdicts(df).collect()
    assert sorted(str(r["page_id"]) for r in out) == sorted(str(k) for k, _ in rows)
    assert all(r["path"] == long[len("http://h.org") :] for r in out if r["page_id"] in (1, 2))
