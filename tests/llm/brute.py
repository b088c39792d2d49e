"""Plain versions of what the operators compute, for small tables: lists of dicts in, dicts out."""

import hashlib
import math
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chat(turns):
    by = defaultdict(list)
    for t in turns:
        by[t["conv_id"]].append((t["turn"], t["role"] or "", t["text"] or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        loss = "".join(x for _, role, x in rows if role == "assistant")
        out[conv] = (len(rows), sha("".join(f"{role}\n{x}\n" for _, role, x in rows)), len(loss), sha(loss))
    return out


def quality(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def votes(text, lang, words_of):
    """What each rule says of a text: -1 bad, 1 good, 0 nothing."""
    text, w = text or "", words(text)
    n, chars = len(w), max(1, sum(map(len, w)))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    k = max(1, len(lines))
    lang = lang.lower() if lang else None
    known = {name: len(set(w) & set(own)) for name, own in words_of.items()}
    function = known[lang] if lang in known else max(known.values())
    latin = 10 * sum(unicodedata.category(c)[0] == "L" and "LATIN" not in unicodedata.name(c, "") and c not in "ªº" for c in text) <= chars
    ended = sum(bool(re.search(r'[.!?"…。！？।؟][\x20\x09-\x0D]*$', x)) for x in lines)
    symbols, upper, exclaim = (len(re.findall(p, text)) for p in (r"[#*$%&|<>]", "[A-Z]", "!"))
    repeated = len(lines) - len(set(lines))
    cases = [
        (symbols > 0.05 * chars, n >= 10 and symbols <= 0.01 * chars),
        (n >= 10 and upper > 0.3 * chars, n >= 30 and upper <= 0.1 * chars),
        (exclaim > 0.02 * chars, n >= 30 and exclaim <= 0.002 * chars),
        (repeated > 0.3 * k, k >= 4 and repeated == 0),
        (n >= 30 and len(set(w)) < 0.4 * n, n >= 30 and len(set(w)) >= 0.6 * n),
        (lang in known and latin and n >= 50 and function < 3, n >= 30 and function >= 6),
        (k >= 2 and ended < 0.5 * k, n >= 10 and ended == k),
        (n >= 10 and latin and (chars > 8 * n or chars < 3 * n), n >= 30 and latin and 4 * n <= chars <= 6.5 * n),
    ]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in cases)


def qualities(docs, words_of, start=(0.05, 0.5), share=0.7, weight=4, steps=500):
    """The posterior of each (text, lang), by expectation-maximisation over documents."""
    cast = [votes(x, lang, words_of) for x, lang in docs]
    rules = range(len(cast[0]))
    rates = [start] * len(rules)

    def p_good(v):
        good, bad = share, 1 - share
        for j in rules:
            if v[j]:
                good *= rates[j][0] if v[j] < 0 else 1 - rates[j][0]
                bad *= rates[j][1] if v[j] < 0 else 1 - rates[j][1]
        return good / (good + bad)

    for _ in range(steps):
        p = [p_good(v) for v in cast]
        rates = [tuple((weight * start[c] + sum(w[c] for w, v in zip(zip(p, (1 - x for x in p), strict=True), cast, strict=True) if v[j] < 0)) / (weight + sum(w[c] for w, v in zip(zip(p, (1 - x for x in p), strict=True), cast, strict=True) if v[j])) for c in (0, 1)) for j in rules]
        share = (sum(p) + 1) / (len(p) + 2)
    return [p_good(v) for v in cast], rates


def base_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in docs}
    tokens = [(i, words((x or "").translate(LOWER)) + ["\n"]) for i, x in docs]
    c = Counter(t for i, ts in tokens if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for i, ts in tokens]


def tree_scores(docs, learns, least=3, discount=0.75, depth=None):
    """log10 of each text's probability by a suffix tree of tuples of words, and how long its contexts are."""
    texts = [["<s>", *words((x or "").translate(LOWER)), "</s>"] for x in docs]
    train = [t for t, own in zip(texts, learns, strict=True) if own]
    c = Counter(w for t in train for w in t[1:])
    n, v = sum(c.values()), len(c)
    root = {w: (k + 1) / (n + v + 1) for w, k in c.items()}
    grown = []  # of each level: context -> (explicit symbols' counts, size, diverges, probabilities so far)
    places = [(t, i) for t in train for i in range(1, len(t))]
    while depth is None or len(grown) < depth:
        level = len(grown) + 1
        places = [(t, i) for t, i in places if i >= level and (level == 1 or tuple(t[i - level + 1 : i]) in grown[-1])]
        sizes = Counter(tuple(t[i - level : i]) for t, i in places)
        symbols = defaultdict(Counter)
        for t, i in places:
            symbols[tuple(t[i - level : i])][t[i]] += 1
        found = {}
        for g, size in sizes.items():
            if size < least:
                continue
            was = root if level == 1 else grown[-1][g[1:]][3]
            own = {s: k for s, k in symbols[g].items() if k >= least and (s in was if level > 1 else c[s] >= least)}
            if not own:
                continue
            p = {s: (k - discount) / size for s, k in own.items()}
            rest, rest_was = (max(1 - sum(x[s] for s in own), 1e-9) for x in (p, was))
            gain = sum(k * math.log(p[s] / was[s]) for s, k in own.items()) + size * rest * math.log(rest / rest_was)
            diverges = gain >= 0.5 * len(own) * math.log(max(size, 2))
            if diverges or level == 1 or grown[-1][g[1:]][2]:
                found[g] = (own, size, diverges, p if diverges else {s: was[s] for s in own})
        if not found:
            break
        grown.append(found)
    kept = {g for level in grown for g, x in level.items() if x[2]}
    kept |= {g[k:] for g in kept for k in range(len(g))}
    table = {}
    for level in grown:
        for g, (own, size, _, _) in level.items():
            if g in kept:
                was = root if len(g) == 1 else table[g[1:]][0]
                p = {s: (k - discount) / size for s, k in own.items()}
                rest, rest_was = (max(1 - sum(x[s] for s in own), 1e-9) for x in (p, was))
                table[g] = (p, rest / rest_was)

    def score(t):
        total = 0.0
        for i in range(1, len(t)):
            p, k = root.get(t[i], 1 / (n + v + 1)), 1
            while k <= i and (x := table.get(tuple(t[i - k : i]))):
                p = x[0].get(t[i], x[1] * p)
                k += 1
            total += math.log10(p)
        return total

    return [score(t) for t in texts], max(map(len, kept), default=0)


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs, k, percent=80):
    """(id, set size, component) of each row; rows with one id are one node."""
    sets = [(i, shingles(x, k)) for i, x in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None else None) for i, s in sets]


def exact(docs):
    groups = defaultdict(list)
    for i, x in docs:
        groups[(x or "").translate(LOWER)].append(i)
    out = []
    for i, x in docs:
        t = (x or "").translate(LOWER)
        keep = max((j for j in groups[t] if j is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, sha(t)))
    return out


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


def lines(docs, least=40, min_docs=5):
    found = defaultdict(set)
    for i, x in docs:
        for line in (x or "").split("\n"):
            if len(line_key(line)) >= least:
                found[line_key(line)].add(i)
    gone = {k: max((i for i in ids if i is not None), default=None) for k, ids in found.items() if len(ids) >= min_docs}
    out = []
    for i, x in docs:
        rows = (x or "").split("\n")
        kept = [r for r in rows if line_key(r) not in gone or gone[line_key(r)] == i]
        out.append((i, len(rows), len(rows) - len(kept), "\n".join(kept)))
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def url_tokens(u):
    if not u or "://" not in u:
        return set(re.findall(r"(?:^|&)([^=&]+)", "")) | {f"query:{x}" for x in query_names(u)}
    host, path, *_ = url(u)
    segments = [x for x in path.translate(LOWER).split("/") if x]
    out = {f"host:{x}" for x in host.split(".") if x} | {f"query:{x}" for x in query_names(u)}
    for x in segments:
        name, _, ending = x.rpartition(".")
        if re.fullmatch(r"[a-z]+", ending) and "." in x:
            out.add(f"ending:{ending}")
        else:
            name = x
        out.add("path:" + ("#" if re.fullmatch(r"[0-9]+", name) else name))
    return out


def query_names(u):
    m = re.search(r"\?([^#]*)", u or "")
    return [x for x in re.findall(r"(?:^|&)([^=&]+)", m.group(1))] if m else []


def judged(pages, least_support=0.002, least_confidence=0.9):
    """The verdict of each page: its given rule's, else that of the best of all mined rules that fits, else allow."""
    given = {i: url(u)[3] for i, u in pages.items()}
    tokens = {i: frozenset(url_tokens(u)) for i, u in pages.items()}
    labelled = [(tokens[i], v) for i, v in given.items() if v]
    least = math.ceil(least_support * len(labelled) - 1e-9)

    def counts(a):
        fits = [v for t, v in labelled if a <= t]
        return len(fits), Counter(fits)

    rules, level = [], [frozenset([x]) for x in sorted(set().union(*(t for t, _ in labelled)))]
    while level:
        grown = set()
        for a in level:
            n, by = counts(a)
            for v, k in by.items():
                if k >= least and k / n >= least_confidence and not any(b <= a and w == v and c >= k / n for b, w, c, _ in rules):
                    rules.append((a, v, k / n, k))
            if max(by.values(), default=0) < n:  # else no longer set tells more
                grown |= {a | {x} for t, _ in labelled if a <= t for x in t - a}
        level = sorted((a for a in grown if max(counts(a)[1].values()) >= least), key=sorted)
    out = {}
    for i, t in tokens.items():
        fits = [(c, s, v == "allow", v) for a, v, c, s in rules if a <= t]
        out[i] = given[i] or (max(fits)[3] if fits else "allow")
    return out


def mixed(rows, weights=(3, 1, 2), share=1.5, repeats=2, seed=17):
    """Copies of each (doc_id, source, size), and each source's target: whole rounds of a source, then documents by a seeded
    hash until the target is met, the last bucket of hashes as full as can be."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:  # one source that is over at a time
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in order if s in open_ and part[s] > repeats * sizes[s]]
        if not over:
            target |= part
            break
        target[over[0]] = float(repeats * sizes[over[0]])
        left -= target[over[0]]
        open_.remove(over[0])

    def key(i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        return h if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), h)

    n = Counter(s for _, s, _ in rows)
    bits = min(20, max(0, math.ceil(math.log2(max([1, *n.values()]) / 256))))
    copies = {}
    for s in order:
        tokens = min(round(target[s]), repeats * sizes[s])
        rounds = min(repeats, tokens // sizes[s]) if sizes[s] else 0
        more = tokens - rounds * sizes[s]
        buckets = defaultdict(Counter)
        for i, source, size in rows:
            if source == s:
                buckets[key(i) >> (64 - bits) if bits else 0][key(i)] += size
        extra = set()
        for b in sorted(buckets):
            inside = sum(buckets[b].values())
            if more <= 0:
                break
            if inside < more:
                extra |= set(buckets[b])
                more -= inside
                continue
            own = sorted(buckets[b].items(), key=lambda x: x[0] - (x[0] >> 63 << 64))
            for h, size in own:
                if size <= more:
                    extra.add(h)
                    more -= size
            rest = [(size, k, h) for k, (h, size) in enumerate(own) if h not in extra]
            if rest and min(rest)[0] - more < more:
                extra.add(min(rest)[2])
            break
        for i, source, _ in rows:
            if source == s:
                copies[i, source] = min(repeats, rounds + (key(i) in extra))
    return copies, target


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def pii(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m.group())]


SECRET, ACCOUNT = "password|passwd|token|api_key|apikey|secret", "account|acct|konto|cuenta|compte"
IBANS = {"GB": 22, "DE": 22}  # those that the test's texts can have
STREET = "Street|Avenue|Road|Lane|Boulevard|Drive|Court|Square|Terrace|St\\.|Ave\\.|Rd\\.|Ln\\.|Blvd\\."


def forms(cues):
    return "|".join(f for c in cues.split("|") for f in (c, c.capitalize(), c.upper()))


def greedy(found):
    """Spans in the order they are found in, without those that begin in the one before."""
    out, end = [], 0
    for s, e in found:
        if s >= end:
            out.append((s, e))
            end = e
    return out


def pii_others(text):
    """The added kinds, each by a pattern tried behind every cue."""
    number = re.compile(r"(?:[ \t]{0,4}(?:no\.?|number|nr\.?|num\.?|#|:|=)){0,3}[ \t]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
    ssn = re.compile(r"(?:[ \t]{0,4}(?:no\.?|number|#|:|=)){0,3}[ \t]{0,4}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])", re.I)
    value = re.compile(r"[ \t]{0,4}[=:][ \t]{0,4}(['\"]?)([A-Za-z0-9+/=_.-]{8,})\1")

    def behind(cues, pattern, group):
        return [m.span(group) for c in re.finditer(f"(?:{forms(cues)})", text) if (m := pattern.match(text, c.end()))]

    ibans = []
    for c in re.finditer("(?:iban|Iban|IBAN)", text):
        for country, n in IBANS.items():
            m = re.compile(rf"[ \t:]{{0,4}}({country}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}})(?![^\W_])").match(text, c.end())
            plain = m.group(1).replace(" ", "") if m else ""
            if m and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(x)) for x in plain[4:] + plain[:4])) % 97 == 1:
                ibans.append(m.span(1))
    hexes = []
    for m in re.finditer(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*", text):
        run = m.group()[:-1] if re.search(r"[^:]:$", m.group()) else m.group()
        sides = text[: m.start()][-1:].isalnum() or text[m.end() :][:1].isalnum()
        groups = run.split(":")
        full = re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", run)
        short = run.count("::") == 1 and ":::" not in run and len([g for g in groups if g]) <= 7 and all(len(g) <= 4 for g in groups) and not re.search(r"^:[^:]|[^:]:$", run)
        if not sides and (full or short) and any(len(g) == 4 for g in groups):
            hexes.append((m.start(), m.start() + len(run)))
    logins = [m.span() for m in re.finditer(r"[A-Za-z0-9.+-]+://[^\s/@:?#]+(?::[^\s/@?#]*)?@[A-Za-z0-9.-]+(?::[0-9]{1,5})?", text)]
    keys = [(m.end() - 16, m.span()) for m in re.finditer(r"(?<![^\W_])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", text)]
    values = [(c.end(), m.span(2)) for c in re.finditer(f"(?:{forms(SECRET)})", text) if (m := value.match(text, c.end()))]
    secrets = [s for _, s in sorted(keys + values)]
    streets = [(h.start(), m.end()) for m in re.finditer(f" (?:{STREET})(?![^\\W_])", text) if (h := re.search(r"(?<!\w)[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'-]{0,30} ){1,4}$", text[: m.start() + 1]))]
    kinds = {"account": behind(ACCOUNT, number, 1), "iban": ibans, "ipv6": hexes, "login": logins, "secret": secrets, "ssn": behind("ssn|social security", ssn, 1), "street": streets}
    return [(kind, *s) for kind, found in kinds.items() for s in greedy(found)]


def alignment(texts, encode_a, bytes_a, encode_b, bytes_b):
    """What op11 says of each text, and its groups; encode_*: text to ids, bytes_*: an id's bytes."""
    rows, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        sides = [(encode(text), of) for encode, of in ((lambda t: encode_a(" " + t), bytes_a), (encode_b, bytes_b))] if text else []
        if not text or any(b"".join(map(of, ids)) != want for ids, of in sides):
            rows.append((0, 0, "", []))
            continue
        ends = []
        for ids, of in sides:
            at, found = 0, []
            for i in ids:
                at += len(of(i))
                found.append((at, i))
            ends.append(found)
        cuts, groups = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}), []
        own = [defaultdict(list), defaultdict(list)]
        for side, into in zip(ends, own, strict=True):
            for e, i in side:
                into[bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(",".join(into[k]) for into in own) for k in range(len(cuts))]
        of_b = defaultdict(list)
        for e, i in ends[1]:
            of_b[e].append(i)
        links = [(i, j) for e, i in ends[0] for j in of_b[e]]
        counts.update(links)
        rows.append((len(ends[0]), len(ends[1]), ";".join(groups), links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(a, b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(groups) if groups else "") for a, b, groups, links in rows]


def near_vectors(rows, least=0.9):
    """{position: (links, component)} of (id, vector) rows; the component is its smallest id that is not null."""
    import numpy as np

    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {k: [j for j, y in good.items() if j != k and len(y) == len(x) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= least] for k, x in good.items()}
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = set(links.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        out[k] = (len(links.get(k, ())), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def damage(rows):
    """(conv, turn, role, text) rows as op12 damages them."""
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def _faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.strip(SPACES)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repair(rows, every_way=False):
    """What op12 says of one conversation's damaged rows (turn, role, text). every_way tries all edits of each row with up to two
    insertions before it, for short conversations; else the best audit of each state is kept as a string."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
    faults = _faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    numbers = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)))

    def moves(k):
        for n in range(3):
            for edit in "DKR" if faults[k] not in ("blank", "duplicate") else "D":
                yield "I" * n + edit, 3 * n + {"D": 4, "K": 0, "R": 3}[edit] + 3 * (edit != "D" and faults[k] == "truncated")

    def after(done, code, row):
        """The lines, or None where no legal roles begin so."""
        lines = list(done)
        roles = "".join(x[:1] for x in lines)
        for c in code:
            if c == "D":
                continue
            turn = "assistant" if roles.endswith("u") else "user"
            lines.append(f"{row[1]}:{row[2]}" if c == "K" else f"{turn}:{row[2] if c == 'R' else ''}")
            roles += row[1][:1] if c == "K" else turn[0]
            if len(roles) < len(lines) or not re.fullmatch("(s?(ua)*u?)?", roles):
                return None
        return lines

    ways = {(): (0, "", [])}
    for k, row in enumerate(rows):
        new = {}
        for cost, audit, lines in ways.values():
            for code, price in moves(k):
                n = len(lines) if every_way else 2 if lines and lines[-1][:1] == "a" else 1
                if (then := after(lines[-n:] if n else [], code, row)) is not None:
                    then = lines[: len(lines) - n] + then if len(lines) > n else then
                    way = (cost + price, audit + code, then)
                    state = way[1] if every_way else "".join(x[:1] for x in then[-1:])
                    if state not in new or way[:2] < new[state][:2]:
                        new[state] = way
        ways = new
    best = []
    for cost, audit, lines in ways.values():
        for closing in ("", "I", "II"):
            then = after(lines[-1:], closing, None) if closing else lines
            then = lines[:-1] + then if closing and then is not None else then
            if then is not None and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in then)):
                best.append((cost + 3 * len(closing), audit + closing, then))
    cost, audit, lines = min(best)
    return (*numbers, cost, audit, sha("\n".join(lines)))
