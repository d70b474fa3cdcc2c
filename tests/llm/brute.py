"""Plain versions of the operators, one row at a time, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, window=50):
    """docs: (doc_id, text) rows; (doc_id, n_words, n_removed, kept_sha256) rows."""
    least = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), sha(kept)))
    return out


def quality_counts(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed,
    )


def fingerprint(text):
    w = [x.encode().lower().decode() for x in words(text)]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_classes(docs, most=2):
    fps = [(doc, fingerprint(text)) for doc, text in docs]
    by = defaultdict(set)
    for doc, fp in fps:
        by[fp].add(doc)
    distinct = sorted(by)
    values = np.array(distinct, np.uint64)
    links = []
    for i, fp in enumerate(distinct):
        near = np.bitwise_count(values[i + 1 :] ^ np.uint64(fp)) <= most
        links += [(fp, distinct[i + 1 + j]) for j in np.flatnonzero(near)]
    label = components(distinct, links)
    least = {}
    for fp in distinct:
        least[label[fp]] = min(least.get(label[fp], min(by[fp])), min(by[fp]))
    return [(doc, f"{fp:016x}", least[label[fp]]) for doc, fp in fps]


def pieces(docs, tokenizer, most=2048):
    out = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), most)):
            own = np.array(ids[at : at + most], "<u4")
            out.append((doc, k, at, len(own), zlib.crc32(own.tobytes())))
    return out


def chat_rows(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) of (conv_id, turn, role, text) rows."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def contaminated(text, items, span, share, least=5):
    """Indexes of the items with an aligned stretch in the text, over all diagonals."""
    fold = lambda t: [x.encode().lower() for x in TOKEN.findall(t or "")]
    doc, found = fold(text), []
    for k, item in enumerate(map(fold, items)):
        if len(item) < least:
            continue
        n = min(span, len(item))
        for d in range(-len(item) + n, len(doc) - n + 1):
            a, b = max(d, 0), min(d + len(item), len(doc))
            equal = [doc[i] == item[i - d] for i in range(a, b)]
            if any(100 * sum(equal[i : i + n]) >= share * n for i in range(len(equal) - n + 1)):
                found.append(k)
                break
    return found


def mask(line):
    """The line with fields masked; one of nothing but fields stays, with the mark at its end."""
    plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ")
    parts = plain.split(" ")
    field = [any(c in "0123456789" for c in p) for p in parts]
    if plain and all(field):
        return plain + "<*>"
    return " ".join("<*>" if f else p for p, f in zip(parts, field))


def recurring(docs, min_docs, leading=3, share=80):
    """{doc_id: masked lines to drop} of the line-template tree; fields match at their place."""
    own = defaultdict(set)
    for doc, text in docs:
        own[doc] |= {mask(x) for x in (text or "").split("\n")} - {""}
    leaf = lambda line: (len(line.split(" ")), *(line.split(" ") + [None] * leading)[:leading])
    held = Counter(line for lines in own.values() for line in lines)
    slots = Counter()
    for line, n in held.items():
        for i, t in enumerate(line.split(" ")):
            if t != "<*>":
                slots[leaf(line), i, t] += n

    def template(line):
        parts = line.split(" ")
        fixed = tuple((i, t) for i, t in enumerate(parts) if t != "<*>" and slots[leaf(line), i, t] >= min_docs)
        matching = len(fixed) + parts.count("<*>")
        return (leaf(line), fixed) if 100 * matching >= share * len(parts) else None

    by = defaultdict(set)
    for doc, lines in own.items():
        for line in lines:
            if template(line):
                by[template(line)].add(doc)
    gone = defaultdict(set)
    for doc, lines in own.items():
        for line in lines:
            t = template(line)
            if t and len(by[t]) >= min_docs and doc > min(by[t]):
                gone[doc].add(line)
    return gone


def without_recurring(docs, min_docs=10):
    """{doc_id: text without its recurring lines}."""
    gone = recurring(docs, min_docs)
    cut = lambda doc, text: "\n".join(x for x in text.split("\n") if mask(x) not in gone[doc])
    return {doc: cut(doc, text) if text is not None else None for doc, text in docs}
