"""Host reputation and licence scans against plain Python."""

import math
import re
from pathlib import Path

import pytest

from precis.llm import host_reputation as H
from precis.llm.license_scan import KNOWN_DIGESTS, known_table, licence_digest, scan_licenses

URLS = [
    "http://a.example.net/en/1?x#y", "https://EXAMPLE.net/de/2", "http://x.example.com/de/", "http://example.com/fr/1",
    "http://q.org/fr/1", "http://q.org/de/1", "org/fr/", None, "", "://", "http://net", "http://net/", "http://anet/",
    "ftp://u:p@Host.Co.UK:80/a/b?c", "x://y://z/w", "http://a.net?q=/en/", "http://a.net#f", "http://É.net/é?",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    rule = None
    for r, _ in H.RULES:
        name, rest = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(r) > len(rule or ""):
            rule = r
    return host, path, rule


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, _id string")


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], None, None)]
    marks = spark.createDataFrame([], "_page long, _bad int")
    out = H.judge_urls(pages(spark, rows), marks).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path, r.rule) == plain(URLS[r.page_id])
        assert r.verdict == (dict(H.RULES)[r.rule] if r.rule else "allow")
    assert H.judge_urls(pages(spark, []), marks).collect() == []


def plain_rates(hosts):
    """{host: (rate, weight)} from {host: (n, bad, suffix, domain)}."""
    def strength(groups):
        extra = sum(n * (b / n - m) ** 2 - m * (1 - m) for n, b, m in groups if n)
        weight = sum((n - 1) * m * (1 - m) for n, b, m in groups if n)
        return min(max(weight / extra - 1, 1.0), 1000.0) if extra > 0 else 1000.0

    def level(key):
        out = {}
        for n, b, s, d in hosts.values():
            x = out.setdefault(key(s, d), [0, 0])
            x[0] += n
            x[1] += b
        return out

    n, b = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values())
    top = (b + 1) / (n + 2)
    suffix = level(lambda s, d: s)
    k = strength([(n, b, top) for n, b in suffix.values()])
    suffix = {s: (b + k * top) / (n + k) for s, (n, b) in suffix.items()}
    domain = level(lambda s, d: (s, d))
    k = strength([(n, b, suffix[s]) for (s, d), (n, b) in domain.items()])
    domain = {x: (b + k * suffix[x[0]]) / (n + k) for x, (n, b) in domain.items()}
    k = strength([(n, b, domain[s, d]) for n, b, s, d in hosts.values()])
    return {h: ((b + k * domain[s, d]) / (n + k), n + k) for h, (n, b, s, d) in hosts.items()}


def test_posterior(spark):
    names = {"a.bad.com": ("com", "bad.com", 60, 55), "b.bad.com": ("com", "bad.com", 3, 3), "c.bad.com": ("com", "bad.com", 0, 0),
             "good.com": ("com", "good.com", 50, 2), "x.good.com": ("com", "good.com", 4, 1), "new.org": ("org", "new.org", 0, 0),
             "p.shop.co.uk": ("co.uk", "shop.co.uk", 5, 2), "localhost": ("localhost", "localhost", 9, 4)}
    rows, marks, hosts = [], [(None, 1), (3, None)], {}
    for name, (s, d, n, bad) in names.items():
        hosts[name] = (n, bad, s, d)
        for k in range(n + 2):  # two unlabelled pages each
            if k < n:
                marks.append((len(rows), int(k < bad)))
            rows.append((len(rows), f"http://{name}/{k}", None, None))
    marks = spark.createDataFrame(marks, "_page long, _bad int")
    want = plain_rates(hosts)
    out = H.judge_urls(pages(spark, rows), marks, rules=()).collect()
    assert len(out) == len(rows)
    for r in out:
        rate, weight = want[r.host]
        assert r.rate == pytest.approx(rate)
        assert r.bound == pytest.approx(rate - 1.64 * math.sqrt(rate * (1 - rate) / (weight + 1)))
        assert r.verdict == ("block" if r.bound > 0.5 else "allow")
    assert {r.host for r in out if r.verdict == "block"} >= {"a.bad.com"}


def test_suffixes_and_domains(spark):
    want = {"a.shop.co.in": ("co.in", "shop.co.in"), "x.gov.uk": ("gov.uk", "x.gov.uk"), "b.c.com.cn": ("com.cn", "c.com.cn"),
            "a.b.example.com": ("com", "example.com"), "co.uk": ("co.uk", "co.uk"), "u@p.q.co.za:80": ("co.za", "q.co.za"),
            "a.b.c.ck": ("c.ck", "b.c.ck"), "x.www.ck": ("ck", "www.ck"), "localhost": ("localhost", "localhost"),
            "10.0.3.4": (H.IP, None), "10.9.3.4:8080": (H.IP, None), "[::1]:80": (H.IP, None), "": ("", ""), "n.ne.jp.": ("ne.jp", "n.ne.jp")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.suffix, r.domain) for r in H.with_levels(hosts, H.suffix_table(spark)).collect()} == want
    own = spark.createDataFrame([("example.com",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in H.with_levels(hosts, own).collect()}
    assert got["a.b.example.com"] == ("example.com", "b.example.com") and got["a.shop.co.in"] == ("in", "co.in")


def test_strangers_under_a_suffix_or_address(spark):
    rows, marks = [], []
    for name in ("bad.co.in", "10.0.3.4"):
        for k in range(60):
            marks.append((len(rows), 1))
            rows.append((len(rows), f"http://{name}/{k}", None, None))
    for k in range(300):
        marks.append((len(rows), 0))
        rows.append((len(rows), f"http://s{k}.{'com' if k % 3 else 'co.in'}/" if k % 2 else f"http://9.8.7.{k}/", None, None))
    new = ["http://new.co.in/", "http://10.9.3.4/"]
    rows += [(9000 + i, u, None, None) for i, u in enumerate(new)]
    marks = spark.createDataFrame(marks, "_page long, _bad int")
    out = {r.page_id: r for r in H.judge_urls(pages(spark, rows), marks, rules=()).collect()}
    assert len(out) == len(rows)
    assert out[0].verdict == out[60].verdict == "block"
    assert out[9000].verdict == out[9001].verdict == "allow"


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""


def test_variants_of_a_licence(spark):
    variants = [ISC, ISC.upper(), ISC.replace("\n", "\r\n  * "), "Copyright (c) 2020 Some One\n\n" + ISC,
                "ISC License\n\n# Copyright 2011-2020, Anyone. All rights reserved.\n(c) 2021 Other\n" + ISC,
                ISC.replace('"AS IS"', "“AS IS”").replace("and/or", "and / or")]
    others = [ISC + "and more", ISC[40:], "Licensed under the ISC licence", "", None, "Copyright (c) 2020 Some One", "x " * 100000]
    texts = variants + others
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, ISC, "x"), (0, ISC, "x")],
                                 "doc_id long, text string, license string")
    out = scan_licenses(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        want = "ISC" if r.doc_id is None or r.doc_id < len(variants) else None
        assert r.license == want, r
    assert len({d for _, d in KNOWN_DIGESTS}) == len(KNOWN_DIGESTS)
    assert scan_licenses(docs.where("false")).collect() == []


LONG = {"Apache-2.0": ("Apache-2.0", "APPENDIX: How"), "Artistic": ("Artistic-1.0-Perl", "The End"), "BSD": ("BSD-3-Clause", None),
        "CC0-1.0": ("CC0-1.0", None), "GFDL-1.2": ("GFDL-1.2", "ADDENDUM: "), "GFDL-1.3": ("GFDL-1.3", "ADDENDUM: "),
        "GPL-1": ("GPL-1.0", "Appendix: How"), "GPL-2": ("GPL-2.0", "How to Apply"), "GPL-3": ("GPL-3.0", "How to Apply"),
        "LGPL-2": ("LGPL-2.0", "How to Apply"), "LGPL-2.1": ("LGPL-2.1", "How to Apply"), "LGPL-3": ("LGPL-3.0", None),
        "MPL-1.1": ("MPL-1.1", "EXHIBIT A -"), "MPL-2.0": ("MPL-2.0", "Exhibit A - ")}
BODY = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "Artistic": "Preamble", "GPL-2": "Preamble", "GPL-3": "Preamble",
        "LGPL-2.1": "Preamble", "MPL-1.1": "1. Definitions", "MPL-2.0": "1. Definitions", "GFDL-1.3": "0. PREAMBLE",
        "CC0-1.0": "Statement of Purpose"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="needs the texts of the licences")
def test_long_licences(spark):
    rows = []
    for file, (name, appendix) in LONG.items():
        text = Path("/usr/share/common-licenses", file).read_text(errors="replace")
        wrapped = re.sub(r"\s+(?=copyright (?!\(c\)|\[|owner\]))", "\n", text, flags=re.I)
        whole = [text, "Copyright Node.js contributors. All rights reserved.\n\n" + text, " ".join(text.split("  ")), wrapped]
        cut = [x[:x.rindex(appendix)] for x in whole[:1] if appendix]
        untitled = [x[x.index(BODY[file]):] for x in [text, *cut] if file in BODY]
        rows += [(name, x) for x in whole + cut + untitled]
        rows.append((None, text[:len(text) // 2]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        assert r.license == rows[r.doc_id][0], rows[r.doc_id][1][:200]


def test_any_copyright_line(spark):
    lines = ["Copyright Node.js contributors. All rights reserved.", "Copyright The Regents of the University of California.",
             "COPYRIGHT: Some One", " * Copyright Ångström AB", "Copyright (c) 2020 Some One"]
    broken = ISC.replace("above copyright notice", "above\ncopyright notice")
    sentences = [ISC + "\ncopyright holders disclaim it", ISC + "\ncopyright the\nsoftware", ISC + "\ncopyrighted by no one"]
    texts = [f"{line}\n\n{ISC}" for line in lines] + ["\n".join(lines) + "\n" + broken, broken]
    docs = spark.createDataFrame(list(enumerate(texts + sentences)), "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        assert r.license == ("ISC" if r.doc_id < len(texts) else None), r


def test_equivalent_spellings_and_own_table(spark):
    frame = spark.createDataFrame([("The Licence, by the copyright owners: non-commercial use",),
                                   ("the license by the COPYRIGHT HOLDERS noncommercial use.",)], "text string")
    digests = {r.d for r in frame.select(licence_digest(frame.text).alias("d")).collect()}
    assert len(digests) == 1
    known = known_table(spark, [("own", digests.pop())])
    docs = frame.selectExpr("1L as doc_id", "text")
    assert [r.license for r in scan_licenses(docs, known).collect()] == ["own", "own"]


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
