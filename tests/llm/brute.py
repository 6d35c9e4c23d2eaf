"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("id", "rev", "key", "words", "pos", "lines", "h", "hits", "component", "u", "v", "n", "a", "b",
            "label", "size", "target", "host", "rule", "digest", "payload", "uri", "hash", "window", "count")


def documents(spark, rows, clash=True):
    """``(doc_id, text[, source])`` rows as a documents table, with columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F
        frame = frame.withColumns({name: F.lit("x") for name in CLASHING})
    return frame


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_duplicates(rows, percent=75):
    """``{row number: (set size, component)}`` over ``(doc_id, text)`` rows with ids."""
    sets = [shingle_set(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            if d is None or e is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=repr)


def targets(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Target by source over ``(doc_id, text, source)`` rows, by resharing round after round."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * size[s]}
        if not over:
            return size, out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
        open_ -= over
    return size, out


def license_places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in phrases.items() for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def line_dedup(rows, least=20, docs=3):
    """``(doc_id, n_lines, n_dropped, kept lines)`` for each row."""
    holders = defaultdict(set)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, lines in split:
        for line in lines:
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    rank = lambda d: (d is not None, d or 0)
    goes = {k: max(h, key=rank) for k, h in holders.items() if len(h) >= docs}
    out = []
    for d, lines in split:
        kept = [x for x in lines if key(x) not in goes or goes[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), kept))
    return out


def warc_rows(rows):
    """``(page_id, bytes, digest, type, refers_to)`` over ``(page_id, html)`` rows."""
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        shared = sum((h or "") == (html or "") for _, h in rows) > 1 and (html or "") in first
        revisits = shared and page != first[html or ""]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisits else "response", first[html or ""] if revisits else None))
    return out


def crc_of(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def item_similarity(text, item, width=5):
    """Largest weighted similarity of an item-sized window, all weights equal."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    own, doc = words(item), words(text)
    if not own:
        return 0.0
    size = min(width, len(own))

    def bag(w):
        return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    target, best = bag(own), 0.0
    for at in range(len(doc)):
        window = bag(doc[at:at + len(own)])
        if window:
            common = sum((window & target).values())
            best = max(best, common / sum((window | target).values()))
    return best


def weighted_similarities(text, items, width=5):
    """``{item: largest similarity of an item-sized window}``, shingles weighted by rarity; items of ``width`` words on."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())

    def bag(w):
        return Counter(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    own, doc = {i: words(t) for i, t in items}, words(text)
    bags = {i: bag(w) for i, w in own.items()}
    postings = defaultdict(list)
    for i, b in bags.items():
        for h in b:
            postings[h].append(i)
    weight = lambda h: int(1000 * math.log(1 + len(items) / max(1, len(postings.get(h, ())))) + 0.5)
    total = {i: sum(n * weight(h) for h, n in b.items()) for i, b in bags.items()}
    best = dict.fromkeys(own, 0.0)
    held = [tuple(doc[i:i + width]) in postings for i in range(len(doc) - width + 1)]
    for length in {len(w) for w in own.values()}:
        for at in range(len(doc) - width + 1):
            if not any(held[at:at + length - width + 1]):
                continue
            window = bag(doc[at:at + length])
            common = Counter()
            for h, n in window.items():
                for i in postings.get(h, ()):
                    common[i] += weight(h) * min(n, bags[i][h])
            size = sum(n * weight(h) for h, n in window.items()) if common else 0
            for i, c in common.items():
                if len(own[i]) == length:
                    best[i] = max(best[i], c / (size + total[i] - c))
    return best


def owners(rows, keep="smallest"):
    """``(id, keep_id, group size, sha256)`` of each ``(doc_id, text)`` row, and the texts with how many rows stay."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    choose = min if keep == "smallest" else max
    own = {t: choose((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, own[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
                   for d, t in rows), key=repr)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_levels(digests, fanout=3):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def merkle(rows, fanout=3):
    """``(id, leaf, subroot, root, proof, folded root)`` over ``(source, id, digest, altered)`` rows."""
    trees = defaultdict(list)
    for source, i, digest, altered in rows:
        trees[source].append(((i is not None, i or 0), digest, i, altered))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: merkle_levels([d for _, d, _, _ in sorted(trees[s], key=lambda r: r[:2])], fanout) for s in order}
    top = merkle_levels([levels[s][-1][0] for s in order], fanout)
    out = []
    for at, s in enumerate(order):
        for pos, (_, digest, i, altered) in enumerate(sorted(trees[s], key=lambda r: r[:2])):
            proof, folded = "", altered or digest
            for place, stack in ((pos, levels[s]), (at, top)):
                for level in stack[:-1]:
                    first = place - place % fanout
                    left, right = "".join(level[first:place]), "".join(level[place + 1:first + fanout])
                    proof, folded, place = proof + left + right, H(left, folded, right), place // fanout
            out.append((i, digest, levels[s][-1][0], top[-1][0], H(proof), folded))
    return sorted(out, key=repr)


def divergence(rows, least=3, top=200):
    """``(lang, source, part, item, value, rank)`` over ``(text, lang, source)`` rows."""
    counts, holders, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        counts[lang, source].update(found)
        holders[lang].update(found.keys())
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        terms = [t for t, n in holders[lang].items() if n >= least]
        n = {s: sum(counts[lang, s][t] for t in terms) for s in sources}

        def rate(count, total):
            return 1 + 10 ** 9 * (count + 1) // (total + len(terms))
        for s in sources:
            pairs = [(sum((p - q) ** 2 // q for p, q in (
                (rate(counts[lang, s][t], n[s]), rate(counts[lang, o][t], n[o])) for t in terms)), o) for o in sources - {s}]
            own = []
            for t in terms:
                c = counts[lang, s][t]
                p, q = rate(c, n[s]), rate(sum(counts[lang, o][t] for o in sources), sum(n.values()))
                if c and p > q:
                    own.append(((p - q) ** 2 // q, t))
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)
