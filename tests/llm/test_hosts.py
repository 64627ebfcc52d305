import math
import random
import re
from collections import Counter

from feedloom.llm import hosts


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def splits(name):
    if not name:
        yield []
    for n in range(1, len(name) + 1):
        for rest in splits(name[n:]):
            yield [name[:n], *rest]


def plain(rows, rules):
    """Everything with dictionaries; names split by listing all splits."""
    counts = Counter()
    for _, _, html in rows:
        text = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", html or "").lower()
        counts.update(re.findall(r"[^\W\d_]{2,}", text))
    total = sum(counts.values()) or 1

    def log(word):
        n = counts.get(word)
        return math.log(n / total) if n else math.log(10 / total) - len(word) * math.log(10)

    memo = {}

    def best(name):
        if name not in memo:
            memo[name] = max(splits(name), key=lambda s: round(sum(map(log, s)), 9)) if len(name) < 15 else [name]
        return memo[name]

    out, train, tokens_of = [], [Counter(), Counter()], []
    prior = Counter()
    for page, url, _ in rows:
        host, path = parts(url)
        text, verdict = rule(host, path, rules)
        tokens = [w for name in re.findall(r"[^\W\d_]+", host) for w in best(name)]
        tokens += ["/" + ("0" if t.isdigit() else t) for t in re.findall(r"[^\W\d_]+|\d+", path.lower())]
        if verdict:
            prior[verdict] += 1
            train[verdict == "block"].update(tokens)
        out.append((page, host, path, text, verdict))
        tokens_of.append(tokens)
    a, b = train
    v = len(a | b)
    other = math.log((b.total() + v + 1) / (a.total() + v + 1))
    odds = math.log((prior["allow"] + 1) / (prior["block"] + 1))
    for i, (page, host, path, text, verdict) in enumerate(out):
        if verdict is None:
            score = sum(math.log((a[t] + 1) / (b[t] + 1)) + other for t in tokens_of[i]) + odds if tokens_of[i] else 0.0
            out[i] = (page, host, path, text, "allow" if round(score, 9) >= 0 else "block")
    return out


def check(pages, rules=hosts.RULES):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.select("page_id", "url", "html").collect()]
    found = [tuple(r)[:5] for r in hosts.judge(pages, rules).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, plain(rows, rules)))
    return found


def test_pages(spark):
    found = check(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert {r[4] for r in found} == {"allow", "block"}


def test_edges(spark):
    html = "<p>cheap pills news farm spam the good news</p><script>var junk</script>" * 3
    rows = [
        (1, None, None), (2, "no scheme", html), (3, "://", html), (4, "http://WWW.Good-News.Example.ORG/es/a?x#y", html),
        (5, "http://example.org/en/12", None), (6, "http://notexample.org/en/12", html), (7, "http://org/", html),
        (8, "http://org", html), (9, "a://b://com/fr/", html), (10, "http://x.com/fr/1", html), (11, "http://x.com/de/1", html),
        (12, "http://cheappills.net/de/99", html), (13, "http://goodnews.net/fr/3", html), (14, "http://é.net/Ä\n1", html),
        (15, "http://h?q=://z", None), (15, "http://h?q=://z", None), (None, "http://spamfarm.com/x", html), (17, "", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({})
    check(pages.selectExpr("*", "1 AS row", "'a' AS host", "2.0 AS score"))
    check(pages.where("page_id in (12, 13)"))
    assert hosts.judge(pages.where("page_id < 0")).count() == 0


def test_segmentation_by_listing_all_splits():
    rng = random.Random(3)
    for _ in range(60):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 100) for _ in range(12)}
        total = sum(counts.values())
        name = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 11)))
        known = {(i, n): counts[name[i : i + n]] for i in range(len(name)) for n in range(1, 5) if name[i : i + n] in counts and i + n <= len(name)}

        def log(words, counts=counts, total=total):
            return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

        found = hosts.best_words(name, known, total)
        assert "".join(found) == name
        assert math.isclose(log(found), max(log(s) for s in splits(name)), abs_tol=1e-9)


def test_long_words_stay_whole(spark):
    word = "donaudampfschifffahrtsgesellschaft"
    pages = [(1, f"http://{word}.de/x", f"<p>{word.title()} {word} und und die die</p>"), (2, f"http://die{word}und.net/", None), (3, "http://org/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["word"]: r["n"] for r in hosts.word_counts(df).collect()}[word] == 2
    names = df.selectExpr("explode(array('die" + word + "und', '" + word + "', 'xy" + word + "')) AS name")
    found = {r["name"]: r["words"] for r in hosts.segmented(names, hosts.word_counts(df)).collect()}
    # With six words in all a string of one letter is likelier than one of two.
    assert found == {f"die{word}und": ["die", word, "und"], word: [word], f"xy{word}": ["x", "y", word]}


def test_split_of_a_very_long_name():
    rng = random.Random(3)
    name = "".join(rng.choice("abc") for _ in range(60_000))
    known = {(i, 3): 500 for i in range(0, 59_000, 7)}
    words = hosts.best_words(name, known, 1000)
    assert "".join(words) == name and len(words) > 8_000


def test_splits_against_all_starts():
    """The plain lattice, which tries every start for every end."""
    rng = random.Random(4)
    for _ in range(400):
        name = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
        total = rng.choice([1, 5, 11, 1000])
        known = {(i, n): rng.randrange(1, total + 1) for i in range(len(name)) for n in range(2, 6) if i + n <= len(name) and rng.random() < 0.2}

        def cost(start, end):
            n = known.get((start, end - start))
            return math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)

        best = [0.0]
        for end in range(1, len(name) + 1):
            best.append(max(best[start] + cost(start, end) for start in range(end)))
        words, at, score = hosts.best_words(name, known, total), 0, 0.0
        for w in words:
            score += cost(at, at + len(w))
            at += len(w)
        assert at == len(name) and abs(score - best[-1]) < 1e-6
