"""Rules and template trees against plain Python."""

import math
import random
import re

from binflow.llm import urls


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def general(s):
    m = re.match(r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", s)
    name, kind = m[1], m[2] or ""
    if re.fullmatch(r"[0-9]+", name):
        name = "#"
    elif re.fullmatch(r"[0-9a-fA-F-]{8,}", name) and re.search("[0-9]", name):
        name = "@"
    elif re.search("[0-9]", name) and len(name) > 12:
        name = "*"
    return name + kind


def tree(rows):
    """rows: (host, parts, blocked or None) -> (host, parts) -> (template, purity)."""
    out = {}
    for host in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == host]
        known = [r[2] for r in own if r[2] is not None]
        walk("", own, (sum(known) + urls.WEIGHT * urls.START) / (len(known) + urls.WEIGHT), 0, out)
    return out


def walk(name, rows, purity, depth, out):
    for r in rows:
        if len(r[1]) == depth:
            out[r[0], r[1]] = ("/" + name.lstrip("/"), purity)
    rows = [r for r in rows if len(r[1]) > depth]
    if all(r[2] is None for r in rows):
        for r in rows:
            out[r[0], r[1]] = (f"/{name.lstrip('/')}/**".replace("//", "/"), purity)
        return
    kids = {}
    for r in rows:
        kids.setdefault(r[1][depth], []).append(r)
    stats = {s: [r[2] for r in k if r[2] is not None] for s, k in kids.items()}
    bare = [s for s in kids if not stats[s]]
    groups = [("*", [x for s in bare for x in kids[s]])] if bare and len(kids) > urls.MOST_CHILDREN else [(s, kids[s]) for s in bare]
    line = sorted((sum(v) / len(v), s) for s, v in stats.items() if v)
    runs = []
    for i, (p, s) in enumerate(line):
        if i:
            q, t = line[i - 1]
            b, k, l, m = sum(stats[s]), len(stats[s]), sum(stats[t]), len(stats[t])
            share = (b + l) / (k + m)
            if p - q > urls.ALIKE * math.sqrt(share * (1 - share) * (1 / k + 1 / m)):
                runs.append([])
        else:
            runs.append([])
        runs[-1].append(s)
    for run in runs:
        groups.append(("|".join(sorted(run)) if len(run) <= urls.MOST_CHILDREN else f"{min(run)}|*", [x for s in run for x in kids[s]]))
    for g, k in groups:
        known = [r[2] for r in k if r[2] is not None]
        walk(f"{name}/{g}", k, (sum(known) + urls.WEIGHT * purity) / (len(known) + urls.WEIGHT), depth + 1, out)


CASES = [
    None, "", "no scheme", "http://", "https://A.Org", "http://x.org?q", "http://x.org/", "http://EXAMPLE.org/es/1", "http://www.example.org/en/12", "http://notexample.org/es/1", "http://a.com/fr/1?x",
    "http://a.com/de/1#y", "http://com/de/", "ftp://b.net/a//b/", "x://y://z/w", "http://a.com/de", "http://h.net/" + "/".join("abcdefghijkl"), "http://h.net/deadbeef01/x.html", "http://h.net/İx/日本",
]


def test_against_plain(spark):
    rng = random.Random(6)
    rows = [(i, u) for i, u in enumerate(CASES * 2)]
    for i in range(600):
        host = rng.choice(["a.example.org", "b.example.com", "c.example.net", "b.example.com"])
        rows.append((1000 + i, f"http://{host}/{rng.choice(['en', 'es', 'de', 'fr', f's{i}'] if i % 3 else ['de', 'x', 'y'])}/{rng.choice([rng.randint(1, 2000), 'page.html', 'de'])}"))
    rows += [(None, "http://a.com/fr/1"), (5, "http://a.com/fr/1")]
    got = urls.judged(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string")).collect()
    facts = []
    for _, u in rows:
        host, path = parse(u)
        parts = [general(s) for s in path.split("/") if s]
        parts = tuple(parts)
        verdict, name = rule(host, path)
        facts.append((host, path, parts, verdict, name))
    known = tree([(h, p, None if v is None else int(v == "block")) for h, _, p, v, _ in facts])
    want = []
    for (i, _), (host, path, parts, verdict, name) in zip(rows, facts, strict=True):
        template, purity = known[host, parts]
        want.append((i, host, path, name, verdict or ("block" if purity >= urls.REJECT else "allow"), template, round(purity, 9)))
    assert sorted(map(str, want)) == sorted(str((*r[:6], round(r.purity, 9))) for r in got)


def test_learns(spark):
    rules = [("block", "s.net", "/bad/1"), ("allow", "s.net", "/good/1")]
    pages = [(i, f"http://s.net/{k}/{i}") for i in range(100, 300) for k in ("bad", "good")] + [(9, "http://t.net/bad/9")]
    got = {(r.path.split("/")[1], r.host): r.verdict for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules).where("rule is null").collect()}
    assert got == {("bad", "s.net"): "block", ("good", "s.net"): "allow", ("bad", "t.net"): "allow"}


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(frame).count() == 0 and urls.judged(frame, rules=()).count() == 0


def test_labels_hold_in_wide_nodes(spark):
    """Verdicts of labelled branches don't depend on how many other sections a host has."""
    rules = [("block", "s.net", "/bad/1"), ("allow", "s.net", "/good/1")]
    pages = [(i, f"http://s.net/{k}/{i}") for i in range(100, 300) for k in ("bad", "good")]
    for wide in (29,):
        rows = pages + [(1000 + i, f"http://s.net/section{i}x/p") for i in range(wide)]
        got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
        assert {r.verdict for r in got if r.path.startswith("/bad/")} == {"block"}
        assert {r.verdict for r in got if not r.path.startswith("/bad/")} == {"allow"}
    for wide in (40,):
        rows = [(i, f"http://h.com/{k}/{i}") for i in range(20) for k in ("de/casino", "fr/news")]
        rows += [(100 + i, f"http://h.com/section{i}x/p") for i in range(wide)] + [(99, "http://h.com/en/casino/5")]
        got = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).where("page_id = 99").first()
        assert got.verdict == "allow" and abs(got.purity - (20 + 0.2) / 42) < 1e-9


def test_wide_labelled_nodes_merge_by_the_test(spark):
    """Many labelled siblings: the groups of the plain walk without a bound on children."""
    rng = random.Random(8)
    rules = [("block", "w.net", f"/s{i}/1") for i in range(45)] + [("allow", "w.net", f"/s{i}/2") for i in range(45)] + [("block", "w.net", "/only"), ("allow", "w.net", "/*/")]
    rows = [f"http://w.net/s{i}/{rng.choice('1123' if i % 3 else '1222223')}{k}" for i in range(45) for k in range(rng.randint(1, 12))]
    rows += ["http://w.net/only/1"] * 3 + ["http://w.net/*/x", "http://w.net/free/1"]
    got = urls.judged(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()
    facts = []
    for u in rows:
        host, path = parse(u)
        fits = [(len(h + p), v) for v, h, p in rules if path.startswith(p)]
        facts.append((host, tuple(general(s) for s in path.split("/") if s), int(max(fits)[1] == "block") if fits else None))
    want = tree(facts)
    assert [round(r.purity, 9) for r in sorted(got)] == [round(want[h, p][1], 9) for h, p, _ in facts]


def test_deep_paths_keep_apart(spark):
    """Branches that differ only far down have templates of their own."""
    deep = "/".join("abcdefghijkl")
    rules = [("block", "d.net", f"/{deep}/bad/1"), ("allow", "d.net", f"/{deep}/good/1")]
    pages = [(i, f"http://d.net/{deep}/{k}/{i}") for i in range(100, 300) for k in ("bad", "good")]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules).where("rule is null").collect()
    assert {(r.path.split("/")[-2], r.verdict) for r in got} == {("bad", "block"), ("good", "allow")}


def test_names_dont_merge_branches(spark):
    """A segment `a|b` is no member of the group of a and b."""
    rules = [("block", "n.net", "/a/1"), ("block", "n.net", "/b/1"), ("allow", "n.net", "/a|b/1")]
    pages = [(i, f"http://n.net/{k}/{i}") for i in range(100, 300) for k in ("a", "b", "a|b")]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), rules).where("rule is null").collect()
    assert {(r.path.split("/")[1], r.verdict) for r in got} == {("a", "block"), ("b", "block"), ("a|b", "allow")}
