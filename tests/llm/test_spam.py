import random
import re

import pytest

from tidemark.llm.phrases import scan
from tidemark.llm.spam import evidence, list_pages, spam_pages, tidy

rng = random.Random(8)
WORDS = "buy cheap online best price sale review outlet discount".split()
THINGS = ["garden hose", "yoga mat", "car tyres"]


def keywords(n=60, sep=", "):
    return sep.join(f"{rng.choice(THINGS)} {rng.choice(WORDS)}" for _ in range(n))


def links(n=20):
    return "\n".join(f"https://www.{rng.choice(WORDS)}{i}.example.com/{rng.choice(WORDS)}" for i in range(n))


PROSE = """Older versions wrote the broker without a manifest, which is why both forms are read today. We collect the cursor
first because its timer may already have fired. When two shards disagree, the newer one wins and the loser is logged.
Memory grows with the number of listeners, not with the size of a message. Call this only from the owning thread;
anything else leaves the queue locked. It took us a while to see that nobody closed the socket after an upgrade.
Tests live next to the code they cover and run without any network. Set the limit to zero to switch caching off."""
CODE = "def f(a, b):\n    x = a[b] + 1\n    return {'x': x}\n" * 20
SPAM = {
    "comma": keywords(),
    "lines": keywords(sep="\n"),
    "semicolon": "# yoga mat\n\n" + keywords(sep="; "),
    "upper": keywords().upper(),
    "comment": "/* " + keywords() + " */\n.a { color: red; }\n",
    "sentences": "Looking for best yoga mat? yoga mat best and yoga mat cheap is what we do, yoga mat! Our yoga mat is the best yoga mat for anyone who wants cheap yoga mat. " * 6,
    "meta": '<html><head><meta name="keywords" content="' + keywords() + '"></head><body></body></html>',
    "tags": "\n".join(f'<span class="tag">{rng.choice(THINGS)} {rng.choice(["red", "size 42", "kids"])} AB-{i}17</span>' for i in range(40)),
    "hashtags": " ".join(f"#{rng.choice(['YogaMat', 'CarTyres'])}{rng.choice(['RedCotton', 'Size42Kids'])}" for _ in range(40)),
    "json": '{"name": "x", "version": "1.0.1", "keywords": [' + ", ".join(f'"{rng.choice(THINGS)} {rng.choice(["red", "kids", "cotton"])}"' for _ in range(40)) + "]}",
    "links": "# Partners\n\n" + links(),
    "anchors": "<ul>" + "\n".join(f'<li><a href="http://shop{i}.test/x">click here</a></li>' for i in range(20)) + "</ul>",
    "bbcode": " ".join(f"[url=https://best{i}.example/a]{i}[/url]" for i in range(20)),
    "angle": "\n".join(f"{i}. <//deal{i}.invalid/q>" for i in range(20)),
    "mixed": "The order of the list matters.\n\n" + keywords(20) + "\n\n" + links(10),
    "long": keywords(30_000),
}
FINE = {
    "prose": PROSE,
    "code": CODE,
    "none": None,
    "empty": "",
    "blank": " \n\t ",
    "short": "yoga mat",
    "explained": "\n".join(f"* [Tool{i}](https://tool{i}.example.com) - reads the {a} of a queue and writes every page that the broker has closed since then, in order" for i, a in enumerate("abcdefghij")),
    "cases": "CASES = [\n" + "\n".join(f'    ("https://{rng.choice(WORDS)}{i}.example.com/x", {i}, "tensor"),' for i in range(20)) + "\n]\n",
    "catalogue": "[" + ",\n".join(f'{{"id": {i}, "title": "{rng.choice(THINGS)}", "variant": "red", "price": {i}.5}}' for i in range(40)) + "]",
    "contents": "# Contents\n\n" + "\n".join(f"* [Reset the parcel {i}](./guide/parcel-{i}.md)" for i in range(20)),
    "requirements": "\n".join(f"{a}-{b}==1.{i}.0" for i, (a, b) in enumerate(zip("cache pool queue matrix tree broker".split() * 3, "slot handle page row leaf topic".split() * 3))),
    "wordlist": "\n".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)),
    "very long": CODE * 300,
    "sentence": "Fix the build of the docs and the build of the site on the server",
    "small readme": "A small tool that reads the log of the server and writes the log of the day. Run the tool on the server, then read the log.",
    "to do": "\n".join(f"- {a} the {b} of the page" for a, b in zip(["fix", "read", "test"], ["head", "foot", "head"])) + "\n- fix it too",
    "rhyme": "row row row your boat gently down the stream merrily merrily merrily merrily life is but a dream",
    "badges": "\n".join(f"[![{b}](https://img.badges.example/{b}.svg)](https://{b}.example.com/tool)" for b in ("build", "docs", "chat", "deps")) + "\n\n# tool",
    "references": "See https://a.example.com/x and https://b.example.org/y, or https://c.example.net/z for what the parser does, and //d.example.com/w for why.",
}


@pytest.fixture(scope="module")
def judged(spark):
    names = [*SPAM, *FINE]
    rows = [(i, f"host{i % 5}" if i % 3 else None, {**SPAM, **FINE}[n]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id bigint, repo string, text string")
    return names, {names[r["doc_id"]]: r for r in spam_pages(df).collect()}


@pytest.mark.parametrize("name", sorted(SPAM))
def test_spam(judged, name):
    assert name in judged[1] and judged[1][name]["spam"]


@pytest.mark.parametrize("name", sorted(FINE))
def test_fine(judged, name):
    assert name not in judged[1] or not judged[1][name]["spam"]


def test_replicated_phrases_are_counted_by_host(spark):
    page = keywords(40)
    rows = [(i, host, page) for i, host in enumerate(["a", "b", "c"])] + [(9, "a", keywords(40) + " only here once more"), (10, "z", page + " and " + links(6))]
    got = {r["doc_id"]: r["replicated"] for r in spam_pages(spark.createDataFrame(rows, "doc_id bigint, repo string, text string")).collect()}
    assert got[0] == got[1] == got[2] == 1.0 and got[9] < 1
    alone = {r["doc_id"]: r["replicated"] for r in spam_pages(spark.createDataFrame([(i, "a", page) for i in range(5)], "doc_id bigint, repo string, text string")).collect()}
    assert set(alone.values()) == {0.0} and len(alone) == 5


def test_phrases_of_pages_that_are_no_lists_count_as_replicated(spark):
    page = keywords(40)
    rows = [(0, "a", page)] + [(i, f"h{i}", CODE * 9 + page) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, repo string, text string")
    got = {r["doc_id"]: r["replicated"] for r in spam_pages(df).collect()}
    assert got == {0: 1.0}


def searches(seed, n=60, pool=120, topic="shop"):
    """A page of ``n`` of a pool's search phrases, of six words each."""
    made = random.Random(topic)
    words = [topic + a + b for a in "abcdefghijklm" for b in "uvwxyz"]
    phrases = [" ".join(made.sample(words, 6)) for _ in range(pool)]
    return "\n".join(random.Random(seed).sample(phrases, n))


def test_phrases_on_many_hosts_are_evidence_of_their_own(spark):
    wide = {i: searches(i) for i in range(31)}
    half = {40 + i: "{'a': [x[1] + y(2)], 'b': {'c': (1, 2)}}\n" * 20 + searches(i, topic="deal") for i in range(16)}
    copies = {60 + i: searches(0, topic="lone") + f"\nand for {chr(97 + i)}" for i in range(6)}
    stock = {70: searches(0, topic="note")} | {71 + i: CODE * 40 + searches(0, topic="note") for i in range(6)}
    rows = [(i, f"h{i}", t) for i, t in (wide | half | copies | stock).items()]
    got = {r["doc_id"]: r for r in spam_pages(spark.createDataFrame(rows, "doc_id bigint, repo string, text string")).collect()}
    assert set(got) == {*wide, *half, *copies, 70}
    assert all(got[i]["variety"] > 3.5 and got[i]["words"] == 360 for i in wide)
    assert all(got[i]["reason"] == "phrases" for i in [*wide, *half])
    assert not any(got[i]["spam"] for i in copies) and got[60]["replicated"] > 0.9
    assert not got[70]["spam"] and got[70]["replicated"] == 1.0 and got[70]["stitched"] == 0.0


def test_one_repeated_phrase_of_a_third_of_all_pages(spark):
    rows = [(i, f"h{i}", f"yoga mat best price\n" * 30 if i % 3 == 0 else f"{PROSE} {i}") for i in range(300)]
    got = spam_pages(spark.createDataFrame(rows, "doc_id bigint, repo string, text string")).filter("spam").collect()
    assert {r["doc_id"] for r in got} == set(range(0, 300, 3))


def test_nothing_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", SPAM["links"]), (1, "a", SPAM["links"]), (None, None, SPAM["links"])], "doc_id bigint, repo string, text string")
    assert [r["spam"] for r in spam_pages(df).collect()] == [True] * 3
    assert spam_pages(df.filter("false")).count() == 0
    clash = df.selectExpr("doc_id", "repo", "text", "1 AS links", "2 AS _text", "3 AS host")
    assert list_pages(clash).count() == 3


def plain_scan(text, extra=()):
    """The same by loops: words of plain lines, their number and that of different ones, and the phrases as sorted tuples."""
    words, phrases = [], set(extra)
    for line in text.split("\n"):
        seen = re.search(r"[^\s/*#\-;%>+•]", line)
        if not seen:
            continue
        behind = line[seen.start() :]
        signs = sum(c in "{}()[]=<>\"'`$@\\+&%^~:_" for c in behind) + line.rstrip().endswith(";")
        if not signs < 0.04 * len(re.sub(r"\s", "", behind)):
            continue
        for part in re.split(r"[,;|/•·●\t\r\"'()\[\]{}<>=:.!?、。，；！？।]|(?<=\s)-(?=\s)", line):
            w = [x for t in re.findall(r"[\w-]+", part) if not re.search(r"\d", t) for x in re.findall(r"[^\W\d_]+", t)]
            words += w
            if 2 <= len(w) < 5:
                phrases.add(tuple(sorted(w)))
            phrases |= {tuple(sorted(w[i : i + 5])) for i in range(len(w) - 4)}
    return len(words), len(set(words)), len(phrases)


def test_scan_against_loops():
    texts = [tidy(t)[0] for t in [*SPAM.values(), *(t for t in FINE.values() if t), PROSE * 50, "a b c d e f", "one", "", "ünï ßtraße 2-pack size-42 x_y foo;", "каша 格安 タイヤ - и ещё"]]
    s = scan(texts)
    for i, t in enumerate(texts):
        assert (s.words[i], s.distinct[i], s.upto[i + 1] - s.upto[i]) == plain_scan(t), t[:80]


def test_pieces_change_nothing(monkeypatch):
    from tidemark.llm import phrases

    text = tidy((PROSE + "\n" + SPAM["lines"] + "\n") * 20)[0]
    whole = scan([text, "", text[:300]])
    monkeypatch.setattr(phrases, "PIECE", 700)
    parts = scan([text, "", text[:300]])
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("total", "plain", "loose", "all_words", "words", "distinct", "phrases", "upto"))
