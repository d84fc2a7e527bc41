"""Small random playlists and plain Python versions of the scores, for brute-force comparison."""

import math
import random
import re
from collections import Counter

WORDS = ["rock", "pop", "mix", "summer", "road", "trip", "sad", "the"]
MEMBERSHIP = "pid long, pos long, track_uri string, artist_uri string, album_uri string"
INFO = "pid long, name string, num_followers long, duration_ms long"


def random_playlists(seed, n=40, tracks=12, hot=0.4):
    """(membership rows, info rows); track 0 and word 'rock' are held by a large share."""
    rng = random.Random(seed)
    members, info = [], []
    for pid in range(n):
        size = rng.choice([1, 1, 2, 3, 5])
        for pos in range(size):
            t = 0 if rng.random() < hot else rng.randrange(tracks)
            members.append((pid, pos, f"t{t}", f"a{t % 3}", f"b{t % 5}"))
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 4]))]
        if rng.random() < hot:
            words.append("rock")
        name = None if rng.random() < 0.1 else " ".join(words)
        info.append((pid, name, rng.choice([0, 0, 1, 1, 2, 50]), rng.choice([1000, 1000, 2000, 5000])))
    return members, info


def tokens(name):
    return Counter(re.findall(r"\w\w+", (name or "").lower()))


def name_cosine(a, b):
    """TF-IDF over the corpus of the two names, term by term."""
    ta, tb = tokens(a), tokens(b)
    if not ta or not tb:
        return 0.0

    def weight(counts, t):
        df = (t in ta) + (t in tb)
        return counts[t] * (math.log(3 / (1 + df)) + 1)

    dot = sum(weight(ta, t) * weight(tb, t) for t in ta if t in tb)
    return dot / math.sqrt(sum(weight(ta, t) ** 2 for t in ta) * sum(weight(tb, t) ** 2 for t in tb))


def brute_pairs(members, info, weights, overlap="set"):
    """Every pair with its six parts and score, best first."""
    bags = {}
    for pid, _, *uris in members:
        for kind, uri in zip(("track", "artist", "album"), uris):
            bags.setdefault(pid, {}).setdefault(kind, []).append(uri)
    rows = {p: row for p, *row in info if p in bags}
    top_f = max(r[1] for r in rows.values()) or 1
    top_d = max(r[2] for r in rows.values()) or 1
    out = []
    for a in sorted(rows):
        for b in sorted(rows):
            if a >= b:
                continue
            parts = {}
            for kind in ("track", "artist", "album"):
                x, y = bags[a][kind], bags[b][kind]
                both = len(set(x) & set(y))
                size = (len(set(x)) + len(set(y))) if overlap == "set" else len(x) + len(y)
                parts[f"{kind}_similarity"] = both / (size - both)
            parts["followers_similarity"] = 1 - abs(rows[a][1] / top_f - rows[b][1] / top_f)
            parts["duration_similarity"] = 1 - abs(rows[a][2] / top_d - rows[b][2] / top_d)
            parts["name_similarity"] = name_cosine(rows[a][0], rows[b][0])
            score = round(sum(weights.get(k, 0) * v for k, v in parts.items()), 9)
            out.append((score, a, b, parts))
    return sorted(out, key=lambda r: (-r[0], r[1], r[2]))
