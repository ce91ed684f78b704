"""The crawl against a small one in Python."""

import random
from collections import defaultdict

from quillspark.operators import ingest


def plain_crawl(links, root, good, max_pages):
    """A queue, first in, first out: ``url -> (depth, turn)`` of what is fetched."""
    seen, queue, docs, fetched = {root: 0}, [root], 0, {}
    while queue and docs < max_pages:
        url = queue.pop(0)
        fetched[url] = (seen[url], len(fetched) + 1)
        docs += url in good
        for dst in [dst for src, dst in links if src == url]:
            if len(seen) >= 4 * max_pages:
                break
            if dst not in seen:
                seen[dst] = seen[url] + 1
                queue.append(dst)
    return fetched


def crawled(spark, links, roots, **options):
    places = defaultdict(int)
    rows = []
    for src, dst in links:
        rows.append((src, dst, places[src]))
        places[src] += 1
    found = ingest.crawl(spark.createDataFrame(rows, "src string, dst string, place int").repartition(3), spark.createDataFrame(list(roots.items()), "site string, url string"), **options).collect()
    got = {(r["site"], r["url"]): (r["depth"], r["turn"]) for r in found}
    assert len(got) == len(found)
    return got


def wanted(links, roots, good, max_pages):
    return {(site, url): at for site, root in roots.items() for url, at in plain_crawl(links, root, good, max_pages).items()}


def test_crawl_has_no_depth_limit_and_counts_indexable_pages(spark):
    chain = [f"http://a.example/p{i:02}" for i in range(26)]
    links = list(zip(chain, chain[1:], strict=False))
    links += [("http://b.example/", f"http://b.example/{k}{i:02}") for k in ("thin", "z") for i in range(40)]
    links += [("http://c.example/", f"http://c.example/thin{i:03}") for i in range(130)]
    links += [("http://b.example/thin00", "http://b.example/late"), ("http://c.example/thin000", "http://c.example/late")]
    roots = {"a.example": chain[0], "b.example": "http://b.example/", "c.example": "http://c.example/"}
    good = {url for link in links for url in link if "thin" not in url}
    got = crawled(spark, links, roots, max_pages=30, indexable=spark.createDataFrame([(u,) for u in good], "url string"))
    assert got == wanted(links, roots, good, 30)


def test_caps_cut_where_a_queue_does(spark):
    """Random sites well above both caps, whose links are in no order."""
    rng = random.Random(4)
    for max_pages, share in ((5, 1.0), (12, 0.5), (9, 0.1)):
        links, roots, good = [], {}, set()
        for host in ("a", "b"):
            pages = [f"http://{host}.example/{rng.randrange(10**6):06}" for _ in range(90)]
            roots[f"{host}.example"] = pages[0]
            for i, src in enumerate(pages):
                links += [(src, dst) for dst in rng.sample(pages, rng.randint(0, 6)) + rng.sample(pages[: i + 4], min(3, i + 4))]
            good |= set(rng.sample(pages, int(len(pages) * share)))
        got = crawled(spark, links, roots, max_pages=max_pages, indexable=spark.createDataFrame([(u,) for u in good], "url string"))
        assert got == wanted(links, roots, good, max_pages)
        assert max(turn for _, turn in got.values()) > max_pages or share == 1.0


def test_robots_leave_out_pages_and_whole_sites(spark):
    links = [(f"http://{h}.example/", f"http://{h}.example/{p}") for h in "abc" for p in ("open", "shut/x", "shut/but")]
    links += [("http://a.example/shut/x", "http://a.example/behind"), ("http://a.example/shut/but", "http://a.example/late"), ("http://a.example/open", "http://b.example/over")]
    robots = [("a.example", "User-agent: *\nDisallow: /shut\nAllow: /shut/but\n"), ("b.example", "User-agent: *\nDisallow: /\n")]
    roots = {f"{h}.example": f"http://{h}.example/" for h in "abc"}
    got = crawled(spark, links, roots, robots=spark.createDataFrame(robots, "site string, body string"))
    barred = {"http://a.example/shut/x"}
    own = [(a, b) for a, b in links if a.split("/")[2] == b.split("/")[2] and b not in barred]
    everything = {url for link in links for url in link}
    assert got == wanted(own, {s: r for s, r in roots.items() if s != "b.example"}, everything, 200)
