"""The crawl by generations against a plain loop with one worker, on random sites with contended redirects."""

import random

import pytest

from skein.plans.config import CrawlConfig
from skein.plans.crawl import crawl
from skein.sources import site

ORIGIN = "http://e.com"


def random_site(seed, n=70):
    r = random.Random(seed)
    path = lambda: f"/p{r.randrange(n)}"
    bodies = []
    for k in range(n // 2):
        links = [path() for _ in range(r.randint(0, 6))]
        canonical = path() if r.random() < 0.2 else None
        bodies.append((k, links, canonical))
    out = {"/": (200, bodies[0][0], [f"/p{i}" for i in range(8)], None, None)}
    for i in range(n):
        x = r.random()
        k, links, canonical = r.choice(bodies[1:])
        out[f"/p{i}"] = (302, None, [], None, path()) if x < 0.35 else (404, None, [], None, None) if x < 0.42 else (200, k, links, canonical, None)
    return out


def html(k, links, canonical):
    return f"<p>{k}</p>" + (f"<link rel=canonical href={canonical}>" if canonical else "") + "".join(f"<a href={x}>x</a>" for x in links)


def one_worker(web, depth_limit, page_limit, budget=10**9, tries=lambda path: [None]):
    """tries: what a URL's attempts give before the last one that counts, which is None."""
    pages, queue, seen, hashes, reserved = [], [], {}, set(), 0

    def consider(key, depth, parent):
        nonlocal reserved
        if key in seen:
            return
        page = {"key": key, "depth": depth, "parent": parent, "verdict": None, "attempts": 0}
        seen[key] = page
        pages.append(page)
        if parent is not None and depth > depth_limit:
            page["verdict"] = "depth-limit"
        elif parent is not None and reserved >= page_limit:
            page["verdict"] = "page-limit"
        else:
            reserved += 1
            queue.append(page)

    consider("/", 0, None)
    stopped = False
    while queue and not stopped:
        page = queue.pop(0)
        at, chain = page["key"], [page["key"]]
        while True:
            status, body, links, canonical, to = web[at]
            for n, gives in enumerate(tries(at)):
                if not budget:
                    stopped, page["verdict"] = True, "http-status" if n else "budget"
                    break
                budget -= 1
                page["attempts"] += 1
            if stopped or status != 302:
                break
            if len(chain) > 5:
                page["verdict"] = "redirect-limit"
            elif to in chain:
                page["verdict"] = "redirect-loop"
            elif seen.get(to, page) is not page:
                page["verdict"] = "duplicate"
            if page["verdict"]:
                break
            seen[to] = page
            chain.append(to)
            at = to
        if page["verdict"]:
            continue
        if status != 200:
            page["verdict"] = "http-status"
            continue
        text = html(body, links, canonical)
        if text in hashes:
            page["verdict"] = "duplicate-content"
            continue
        hashes.add(text)
        page["verdict"] = "ok"
        if canonical and canonical != page["key"]:
            page["verdict"] = "canonical"
            consider(canonical, page["depth"], page["key"])
        for key in sorted(set(links)):
            consider(key, page["depth"] + 1, page["key"])
    return [(p["key"], p["parent"], p["depth"], p["verdict"] or "queued", p["attempts"]) for p in pages]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crawl_equals_one_worker(spark, seed):
    web = random_site(seed)
    rows = [(ORIGIN + p, 1, s, "text/html", to, None, None, html(k, links, c) if s == 200 else "", None) for p, (s, k, links, c, to) in web.items()]
    config = CrawlConfig(start_url=ORIGIN, max_depth=4, max_pages=40, respect_robots=False)
    result = crawl(spark, config, site.web(spark.createDataFrame(rows, site.RESPONSES)))
    cut = lambda u: u and u[len(ORIGIN) :]
    got = [(cut(r.canonicalUrl), cut(r.discoveredFrom), r.depth, r.skipReason or r.errorKind or r.state, r.attempts) for r in result.pages.orderBy("created_ord").collect()]
    want = one_worker(web, 4, 40)
    assert {v for *_, v, _ in want} >= {"ok", "duplicate"}
    assert got == want


@pytest.mark.parametrize("budget", [1, 9, 23])
def test_budget_equals_one_worker(spark, budget):
    """Attempts run out before a page, between its redirects or between its retries."""
    web = random_site(5)
    flaky = lambda path: [503] * (sum(map(ord, path)) % 3) + [None]
    rows = []
    for p, (s, k, links, c, to) in web.items():
        rows += [(ORIGIN + p, i + 1, x, "text/html", None, None, None, "", None) for i, x in enumerate(flaky(p)[:-1])]
        rows.append((ORIGIN + p, len(flaky(p)), s, "text/html", to, None, None, html(k, links, c) if s == 200 else "", None))
    config = CrawlConfig(start_url=ORIGIN, max_depth=3, max_pages=40, respect_robots=False, max_total_attempts=budget)
    result = crawl(spark, config, site.web(spark.createDataFrame(rows, site.RESPONSES)))
    cut = lambda u: u and u[len(ORIGIN) :]
    got = [(cut(r.canonicalUrl), cut(r.discoveredFrom), r.depth, r.skipReason or r.errorKind or r.state, r.attempts) for r in result.pages.orderBy("created_ord").collect()]
    assert got == one_worker(web, 3, 40, budget, flaky) and result.stop_reason == "budget"
