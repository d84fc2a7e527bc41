"""The same results in plain SQL over the star schema tables."""

CTES = {
    "trk": """
        SELECT ('0x' || substr(md5('part:' || p_partkey), 1, 15))::BIGINT AS tid, 'part:' || p_partkey AS track_uri,
               p_name AS track_name, p_brand || '/' || p_type AS album_name,
               'album:' || p_brand || '/' || p_type AS album_uri, p_brand AS artist_name,
               'artist:' || p_brand AS artist_uri, round(p_retailprice * 10)::BIGINT AS duration_ms,
               p_partkey AS part_key
        FROM part""",
    "mem": """
        SELECT l_orderkey AS pid,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                  l_quantity, l_extendedprice) - 1 AS pos,
               trk.* EXCLUDE (part_key)
        FROM lineitem JOIN trk ON l_partkey = part_key""",
    "info": """
        SELECT o_orderkey AS pid, coalesce(first_name || ' ', '') || c_mktsegment AS name,
               o_orderpriority = '1-URGENT' AS collaborative, epoch(o_orderdate)::BIGINT AS modified_at,
               coalesce(n_albums, 0) AS num_albums, coalesce(n_artists, 0) AS num_artists,
               coalesce(edits, 0)::BIGINT AS num_edits, floor(o_totalprice / 1000)::BIGINT AS num_followers,
               coalesce(n_tracks, 0) AS num_tracks, coalesce(total_ms, 0)::BIGINT AS duration_ms
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT mem.pid, count(*) AS n_tracks, count(DISTINCT artist_uri) AS n_artists,
                          count(DISTINCT album_uri) AS n_albums, sum(duration_ms) AS total_ms,
                          max(edits) AS edits, max(CASE WHEN pos = 0 THEN track_name END) AS first_name
                   FROM mem JOIN (SELECT l_orderkey AS pid, max(l_linenumber) AS edits FROM lineitem GROUP BY 1) e
                        ON mem.pid = e.pid
                   GROUP BY mem.pid) s ON s.pid = o_orderkey""",
    "thr": "SELECT quantile_cont(num_followers, 0.99) AS t FROM info",
    "capped": """
        SELECT info.*, CASE WHEN num_followers <= t THEN num_followers::DOUBLE
                            WHEN num_followers > t THEN t END AS num_followers_capped, t FROM info, thr""",
    "kept": "SELECT info.* FROM info, thr WHERE num_followers <= t",
    "few": "SELECT * FROM kept WHERE num_tracks <= 350",
    "pts": "SELECT pid, num_tracks, num_followers, modified_at FROM kept "
           "WHERE substr(md5(pid::VARCHAR), 1, 8) < '1999999a'",
    "spl": "SELECT mem.*, substr(md5(pid || ':' || pos), 1, 8) < '40000000' AS holdout FROM mem",
    "chal": """
        SELECT info.pid, CASE WHEN substr(md5('name:' || info.pid), 1, 8) >= '1999999a' THEN name END AS name,
               coalesce(held, 0) AS num_holdouts, coalesce(kept, 0) AS num_samples,
               coalesce(held, 0) + coalesce(kept, 0) AS num_tracks
        FROM info LEFT JOIN (SELECT pid, count(*) FILTER (holdout) AS held, count(*) FILTER (NOT holdout) AS kept
                             FROM spl GROUP BY pid) s ON s.pid = info.pid""",
    "idx": """
        SELECT trk.*, a.i AS album_index, b.i AS artist_index, c.i AS track_index FROM trk
        JOIN (SELECT album_name v, (row_number() OVER (ORDER BY count(*) DESC, album_name) - 1)::DOUBLE i
              FROM trk GROUP BY 1) a ON a.v = album_name
        JOIN (SELECT artist_name v, (row_number() OVER (ORDER BY count(*) DESC, artist_name) - 1)::DOUBLE i
              FROM trk GROUP BY 1) b ON b.v = artist_name
        JOIN (SELECT track_name v, (row_number() OVER (ORDER BY count(*) DESC, track_name) - 1)::DOUBLE i
              FROM trk GROUP BY 1) c ON c.v = track_name""",
    "scl": """
        SELECT idx.*,
               CASE WHEN a1 = a0 THEN 0.5 ELSE (album_index - a0) / (a1 - a0) END AS s1,
               CASE WHEN b1 = b0 THEN 0.5 ELSE (artist_index - b0) / (b1 - b0) END AS s2,
               CASE WHEN c1 = c0 THEN 0.5 ELSE (track_index - c0) / (c1 - c0) END AS s3,
               CASE WHEN d1 = d0 THEN 0.5 ELSE (duration_ms - d0) / (d1 - d0) END AS s4
        FROM idx, (SELECT min(album_index) a0, max(album_index) a1, min(artist_index) b0, max(artist_index) b1,
                          min(track_index) c0, max(track_index) c1, min(duration_ms)::DOUBLE d0,
                          max(duration_ms)::DOUBLE d1 FROM idx)""",
    "vec": """
        SELECT *, CASE WHEN l = 0 THEN s1 ELSE s1 / l END AS v1, CASE WHEN l = 0 THEN s2 ELSE s2 / l END AS v2,
               CASE WHEN l = 0 THEN s3 ELSE s3 / l END AS v3, CASE WHEN l = 0 THEN s4 ELSE s4 / l END AS v4
        FROM (SELECT *, sqrt(s1 * s1 + s2 * s2 + s3 * s3 + s4 * s4) AS l FROM scl)""",
    "wrd": """
        SELECT pid, word, count(*)::DOUBLE AS n
        FROM (SELECT pid, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]{2,}')) AS word FROM info)
        GROUP BY 1, 2""",
    "bag": """
        SELECT info.pid, list_sort(list_distinct(list(track_uri))) AS t, list_sort(list_distinct(list(artist_uri))) AS a,
               list_sort(list_distinct(list(album_uri))) AS b, any_value(info.num_followers) AS f,
               any_value(info.duration_ms) AS d, any_value(info.name) AS name
        FROM info JOIN mem ON mem.pid = info.pid GROUP BY info.pid""",
}
NEEDS = {
    "trk": [], "mem": ["trk"], "info": ["mem"], "thr": ["info"], "capped": ["info", "thr"], "kept": ["info", "thr"],
    "few": ["kept"], "pts": ["kept"], "spl": ["mem"], "chal": ["info", "spl"], "idx": ["trk"], "scl": ["idx"],
    "vec": ["scl"], "wrd": ["info"], "bag": ["info", "mem"],
}


def sql(body: str, *tables: str, **local: str) -> str:
    """`body` behind the table expressions it needs, in order of dependence, then its own."""
    used: list[str] = []

    def add(name):
        for need in NEEDS[name]:
            add(need)
        if name not in used:
            used.append(name)

    for name in tables:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in used] + [f"{n} AS MATERIALIZED ({s})" for n, s in local.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0 AS {name}"


def top(source: str, key: str, name: str, body: str) -> str:
    return f"""
        SELECT row_number() OVER (ORDER BY n DESC, {key}) AS rank, {key},
               (SELECT min({name}) FROM trk WHERE trk.{key} = c.{key}) AS {name}, n
        FROM (SELECT {key}, count(*) AS n FROM {source} {body} GROUP BY {key} ORDER BY n DESC, {key} LIMIT 10) c"""


def histogram(source: str, column: str, bins: int, where: str = "") -> str:
    return f"""
        SELECT i AS bin, {r(f'lo + i * w', 'bin_lo')}, {r(f'lo + (i + 1) * w', 'bin_hi')},
               (SELECT count(*) FROM {source} WHERE least(floor(({column} - lo) / w), {bins - 1}) = i) AS n
        FROM (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column}))::DOUBLE / {bins} AS w FROM {source}),
             range({bins}) g(i) {where}"""


def kernel(column: str, source: str) -> str:
    return f"""
        SELECT i AS point, {r('max(lo + i * step)', 'x')},
               {r('sum(n * exp(-0.5 * ((lo + i * step - v) / h) ** 2)) / (max(total) * max(h) * sqrt(2 * pi()))', 'density')}
        FROM (SELECT {column}::DOUBLE AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1),
             (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column}))::DOUBLE / 199 AS step,
                     stddev_samp({column}) * count({column}) ** -0.2 AS h, count({column}) AS total FROM {source}),
             range(200) g(i) GROUP BY i"""


def hexagons(x: str) -> str:
    return f"""
        SELECT {r('x0 + cu * sx', 'x_center')}, {r('y0 + cv * sy', 'y_center')}, count(*) AS n
        FROM (SELECT *, CASE WHEN near THEN floor(u + 0.5) ELSE floor(u) + 0.5 END AS cu,
                        CASE WHEN near THEN floor(v + 0.5) ELSE floor(v) + 0.5 END AS cv
              FROM (SELECT *, (u - floor(u + 0.5)) ** 2 + 3 * (v - floor(v + 0.5)) ** 2
                              < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 AS near
                    FROM (SELECT x0, y0, sx, sy, ({x} - x0) / sx AS u, (num_followers - y0) / sy AS v
                          FROM pts, (SELECT min({x})::DOUBLE AS x0, min(num_followers)::DOUBLE AS y0,
                                            (max({x}) - min({x}))::DOUBLE / 50 AS sx,
                                            (max(num_followers) - min(num_followers))::DOUBLE / 28 AS sy FROM pts))))
        GROUP BY x0, y0, sx, sy, cu, cv"""


def summary_quantiles(metric: str, source: str, digits: int, **probabilities: float) -> str:
    """Quantiles over values that stand for all that agree in their leading digits; the values are 1 or more."""
    def order(place):
        return f"min(CASE WHEN upto > {place} THEN v END)"

    columns = ", ".join(
        r(f"{order(f'floor({p} * (total - 1))')} + ({order(f'ceil({p} * (total - 1))')} - {order(f'floor({p} * (total - 1))')})"
          f" * max({p} * (total - 1) - floor({p} * (total - 1)))", name) for name, p in probabilities.items())
    return f"""
        SELECT '{metric}' AS metric, {columns}
        FROM (SELECT v, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, (sum(n) OVER ())::DOUBLE AS total
              FROM (SELECT CASE WHEN min({metric}) = max({metric}) THEN min({metric}) ELSE (min({metric}) + max({metric})) / 2 END AS v,
                           count(*) AS n
                    FROM {source} WHERE CASE WHEN {metric} < 1 THEN error('below 1') ELSE true END
                    GROUP BY length(floor({metric})::BIGINT::VARCHAR),
                             floor({metric} / pow(10.0::DOUBLE, length(floor({metric})::BIGINT::VARCHAR) - {digits}))))"""


def box(metric: str, column: str) -> str:
    return f"""
        SELECT '{metric}' AS metric, {r('q1', 'q1')}, {r('q2', '"median"')}, {r('q3', 'q3')},
               {r(f'min(CASE WHEN {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {column} END)',
                  'whisker_lo')},
               {r(f'max(CASE WHEN {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {column} END)',
                  'whisker_hi')},
               count(*) FILTER (NOT {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM capped, (SELECT quantile_cont({column}::DOUBLE, 0.25) q1, quantile_cont({column}::DOUBLE, 0.5) q2,
                             quantile_cont({column}::DOUBLE, 0.75) q3 FROM capped)
        GROUP BY q1, q2, q3"""


def tfidf(source: str, key: str, fields: list[str], where: str = "") -> str:
    cells = " UNION ALL ".join(
        f"SELECT {key}, '{f}' AS field, unnest(regexp_split_to_array(lower({f}), '\\s')) AS token FROM {source}"
        for f in fields)
    return f"""
        SELECT {key}, field, token, tf, {r('idf', 'idf')}, {r('tf * idf', 'tfidf')}
        FROM (SELECT *, ln((SELECT count(*) + 1 FROM {source})::DOUBLE
                           / (count(*) OVER (PARTITION BY field, token) + 1)) AS idf
              FROM (SELECT {key}, field, token, count(*) AS tf FROM ({cells}) {where} GROUP BY ALL))"""


UNIT = dict(part="""
        SELECT tid, field, token, tf * idf AS w FROM ("""
    + tfidf("trk", "tid", ["track_name", "album_name", "artist_name"],
            "WHERE token NOT IN ('and', 'of', 'ring', 'the')").replace(r("idf", "idf"), "idf") + """)
        UNION ALL
        SELECT tid, 'duration', '', CASE WHEN hi = lo THEN 0.5 ELSE (duration_ms - lo)::DOUBLE / (hi - lo) END
        FROM trk, (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi FROM trk)""",
    unit="""SELECT tid, field, token, coalesce(w / nullif(l, 0), 0) AS w
            FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY tid)) AS l FROM part)""")
HASHED = dict(
    tok="""SELECT *, ('0x' || substr(md5(token), 1, 15))::BIGINT % 48 AS bucket FROM ("""
        + tfidf("trk", "tid", ["track_name", "album_name", "artist_name"]) + """)""",
    hashed="""SELECT *, ln(((SELECT count(*) FROM trk) + 1)::DOUBLE / (count(*) OVER (PARTITION BY field, bucket) + 1)) AS idf
              FROM (SELECT tid, field, bucket, sum(tf)::BIGINT AS tf FROM tok GROUP BY ALL)
              JOIN (SELECT field, bucket, count(DISTINCT token) AS terms FROM tok GROUP BY ALL) USING (field, bucket)""")


C2 = "((1 + ln(1.5)) * (1 + ln(1.5)))"
NAME_PARTS = {
    "nen": "SELECT pid, sum(n * n) AS e FROM wrd GROUP BY pid",
    # Names repeat, so similarities are worked out once per pair of different names.
    "nam": "SELECT name, min(pid) AS rep FROM info GROUP BY name",
    "nsim": f"""
        SELECT a.name AS name_a, b.name AS name_b,
               dot / sqrt(({C2} * ea.e - ({C2} - 1) * sa) * ({C2} * eb.e - ({C2} - 1) * sb)) AS cos
        FROM (SELECT x.pid AS pa, y.pid AS pb, sum(x.n * y.n) AS dot, sum(x.n * x.n) AS sa, sum(y.n * y.n) AS sb
              FROM wrd x JOIN wrd y ON x.word = y.word
              WHERE x.pid IN (SELECT rep FROM nam) AND y.pid IN (SELECT rep FROM nam) GROUP BY 1, 2)
        JOIN nen ea ON ea.pid = pa JOIN nen eb ON eb.pid = pb JOIN nam a ON a.rep = pa JOIN nam b ON b.rep = pb""",
}


SHARED_TRACK = """
    SELECT DISTINCT x.pid AS pid_a, y.pid AS pid_b FROM mem x JOIN mem y ON x.track_uri = y.track_uri AND x.pid < y.pid"""
ALIKE_NAMES = """
    SELECT x.pid AS pid_a, y.pid AS pid_b FROM bag x JOIN bag y ON x.pid < y.pid
    LEFT JOIN nsim ON name_a = x.name AND name_b = y.name
    ORDER BY round(coalesce(cos, 0), 9) DESC, 1, 2 LIMIT 10"""


def pairs(weights: tuple[float, ...], candidates: str, least: float) -> str:
    """Best pairs of `candidates`; weights in the order track, artist, album, followers, duration, name.

    No other pair can score above `least`, and the statement fails if the list does not stay above it.
    """
    def jaccard(c):
        inter = f"len(list_intersect(x.{c}, y.{c}))"
        return f"{inter} / (len(x.{c}) + len(y.{c}) - {inter})::DOUBLE"

    parts = ["ts", "rs", "bs", "fs", "ds", "ns"]
    score = " + ".join(f"{w!r}::DOUBLE * {p}" for w, p in zip(weights, parts))
    local = dict(NAME_PARTS, cand=candidates, best=f"""
        SELECT pid_a, pid_b, ts, rs, bs, fs, ds, ns, round({score}, 9) AS score
        FROM (SELECT pid_a, pid_b, {jaccard('t')} AS ts, {jaccard('a')} AS rs, {jaccard('b')} AS bs,
                     1 - abs(coalesce(x.f::DOUBLE / nullif(mf, 0), 0) - coalesce(y.f::DOUBLE / nullif(mf, 0), 0)) AS fs,
                     1 - abs(coalesce(x.d::DOUBLE / nullif(md, 0), 0) - coalesce(y.d::DOUBLE / nullif(md, 0), 0)) AS ds,
                     coalesce(cos, 0) AS ns
              FROM cand JOIN bag x ON x.pid = pid_a JOIN bag y ON y.pid = pid_b
              LEFT JOIN nsim ON name_a = x.name AND name_b = y.name,
                   (SELECT max(f) AS mf, max(d) AS md FROM bag))
        ORDER BY score DESC, pid_a, pid_b LIMIT 10""")
    return sql(f"""
        SELECT CASE WHEN (SELECT min(score) FROM best) <= {least} THEN error('list reaches unseen pairs')
                    ELSE pid_a END::BIGINT AS pid_a, pid_b, {r('ts', 'track_similarity')},
               {r('rs', 'artist_similarity')}, {r('bs', 'album_similarity')}, {r('fs', 'followers_similarity')},
               {r('ds', 'duration_similarity')}, {r('ns', 'name_similarity')}, {r('score', 'final_similarity')}
        FROM best""", "bag", "wrd", **local)


def shared(masks: list[str]) -> str:
    """How many members two sets share, given as masks of 64 members each."""
    return "(" + " + ".join(f"bit_count(x.{m} & y.{m})" for m in masks) + ")"


def overlap(n: str, size: str) -> str:
    return f"{n} / (x.{size} + y.{size} - {n})::DOUBLE"


def mask_of(column: str, masks: list[str]) -> str:
    """Members of a list column, numbered over all lists, as masks; there may be 64 for each mask."""
    bits = ", ".join(f"bit_or(CASE WHEN i // 64 = {j} THEN 1::UBIGINT << (i % 64)::UBIGINT ELSE 0::UBIGINT END) AS {m}"
                     for j, m in enumerate(masks))
    return f"""
        SELECT pid, {bits}, max(CASE WHEN i >= {64 * len(masks)} THEN error('too many members') END) AS spare
        FROM (SELECT pid, unnest({column}) AS v FROM bag)
        JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT unnest({column}) AS v FROM bag))
        USING (v) GROUP BY pid"""


ARTIST_MASKS, ALBUM_MASKS = ["a0"], ["b0", "b1", "b2"]
TRACK_ROWS = "(SELECT DISTINCT pid, track_uri FROM mem)"
# Every pair of playlists is scored; the ten best of each are kept while they pass.
EACH = dict(
    NAME_PARTS, ma=mask_of("a", ARTIST_MASKS), mb=mask_of("b", ALBUM_MASKS),
    st=f"""SELECT x.pid AS a, y.pid AS b, count(*) AS n FROM {TRACK_ROWS} x JOIN {TRACK_ROWS} y
           ON x.track_uri = y.track_uri AND x.pid <> y.pid GROUP BY ALL""",
    msk=f"""SELECT bag.pid, name, len(t) AS nt, len(a) AS na, len(b) AS nb, {', '.join(ARTIST_MASKS + ALBUM_MASKS)},
                   coalesce(f::DOUBLE / nullif(mf, 0), 0) AS f, coalesce(d::DOUBLE / nullif(md, 0), 0) AS d
            FROM bag JOIN ma ON ma.pid = bag.pid JOIN mb ON mb.pid = bag.pid,
                 (SELECT max(f) AS mf, max(d) AS md FROM bag)""",
    best=f"""SELECT pid, arg_max({{'q': q, 'ts': ts, 'rs': rs, 'bs': bs, 'fs': fs, 'ds': ds, 'ns': ns, 'score': score}},
                                {{'score': score, 'first': -q}}, 10) AS list
             FROM (SELECT *, round(6 / 24::DOUBLE * ts + 6 / 24::DOUBLE * rs + 6 / 24::DOUBLE * bs
                                   + 1 / 24::DOUBLE * fs + 1 / 24::DOUBLE * ds + 4 / 24::DOUBLE * ns, 9) AS score
                   FROM (SELECT x.pid AS pid, y.pid AS q, {overlap('coalesce(st.n, 0)', 'nt')} AS ts,
                                {overlap(shared(ARTIST_MASKS), 'na')} AS rs, {overlap(shared(ALBUM_MASKS), 'nb')} AS bs,
                                1 - abs(x.f - y.f) AS fs, 1 - abs(x.d - y.d) AS ds, coalesce(cos, 0) AS ns
                         FROM msk x JOIN msk y ON x.pid <> y.pid LEFT JOIN st ON st.a = x.pid AND st.b = y.pid
                         LEFT JOIN nsim ON name_a = x.name AND name_b = y.name))
             GROUP BY pid""")


NEAREST = """
    SELECT c.pid AS target_pid, arg_max(i.pid, (round(coalesce(cos, 0), 9), -i.pid)) AS pid,
           max(round(coalesce(cos, 0), 9)) AS name_similarity
    FROM chal c JOIN info i ON i.pid <> c.pid AND i.num_tracks > 0 AND c.num_samples = 0
    LEFT JOIN nsim ON name_a = c.name AND name_b = i.name GROUP BY c.pid"""
DOT = "q.v1 * t.v1 + q.v2 * t.v2 + q.v3 * t.v3 + q.v4 * t.v4"
MEAN = "avg(v1) AS v1, avg(v2) AS v2, avg(v3) AS v3, avg(v4) AS v4"


def recommended(k: int) -> str:
    """Every track scored against every playlist vector `q`, own seeds left out."""
    return f"""
        SELECT pid, tid, score, row_number() OVER (PARTITION BY pid ORDER BY score DESC, tid) AS rank
        FROM (SELECT q.pid, t.tid, round({DOT}, 9) AS score FROM q, vec t)
        ANTI JOIN own USING (pid, tid)
        QUALIFY rank <= {k}"""


OWN = "SELECT DISTINCT pid, tid FROM spl WHERE NOT holdout"
SEEDED = dict(own=OWN, q=f"SELECT pid, {MEAN} FROM spl JOIN vec USING (tid) WHERE NOT holdout GROUP BY pid",
              rec=recommended(10))
MEM = "pid, pos, tid, track_uri, track_name, album_name, album_uri, artist_name, artist_uri, duration_ms"
CAT = "tid, track_uri, track_name, album_name, album_uri, artist_name, artist_uri, duration_ms"
FEATURES = ["num_followers", "num_artists", "num_albums", "num_tracks", "modified_at"]

def metrics_sql(ks: str, *tables: str, **local: str) -> str:
    """Ranking metrics of the list `rec` against `labels_of`, at each length of `ks`."""
    return sql(f"""
        SELECT k, {r('avg(hits / k)', 'precision')}, {r('avg(hits / n)', 'recall')},
               {r('avg(ap / least(n, k))', 'map')}, {r('avg(dcg / ideal)', 'ndcg')}, count(*) AS n_playlists
        FROM (SELECT ks.k, lab.pid, n, coalesce(count(h.rank), 0)::DOUBLE AS hits, coalesce(sum(h.nth / h.rank), 0) AS ap,
                     coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg,
                     (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, ks.k) + 1) g(i)) AS ideal
              FROM {ks} ks(k),
                   (SELECT pid, count(*) AS n FROM labels_of GROUP BY pid) lab
              LEFT JOIN (SELECT pid, rank, row_number() OVER (PARTITION BY pid ORDER BY rank)::DOUBLE AS nth
                         FROM rec JOIN labels_of USING (pid, tid)) h ON h.pid = lab.pid AND h.rank <= ks.k
              GROUP BY ks.k, lab.pid, n)
        GROUP BY k""", *tables, **local)


ORACLE: dict[str, str] = {
    "ingest_playlists": sql("SELECT * FROM info", "info"),
    "ingest_membership": sql(f"SELECT {MEM} FROM mem", "mem"),
    "track_catalogue": sql(f"SELECT {CAT} FROM trk WHERE part_key IN (SELECT l_partkey FROM lineitem)", "trk"),
    "ingest_challenge": sql(f"SELECT {MEM} FROM spl WHERE NOT holdout", "spl"),
    "challenge_info": sql("SELECT * FROM chal", "chal"),
    "holdout_split": sql("SELECT pid, pos, tid, holdout FROM spl", "spl"),
    "top_opening_tracks": sql(top("mem", "track_uri", "track_name", "WHERE pos = 0"), "mem"),
    "top_closing_tracks": sql(
        top("(SELECT *, max(pos) OVER (PARTITION BY pid) AS last FROM mem)", "track_uri", "track_name",
            "WHERE pos = last"), "mem"),
    "top_tracks": sql(top("mem", "track_uri", "track_name", ""), "mem"),
    "top_artists": sql(top("trk", "artist_uri", "artist_name", ""), "trk"),
    "top_albums": sql(top("trk", "album_uri", "album_name", ""), "trk"),
    "top_artists_by_appearances": sql(top("mem", "artist_uri", "artist_name", ""), "mem"),
    "top_albums_by_appearances": sql(top("mem", "album_uri", "album_name", ""), "mem"),
    "genre_counts": sql("""
        SELECT genre, (SELECT count(*) FROM info WHERE contains(name, genre)) AS n_playlists
        FROM (VALUES ('ring'), ('gear'), ('plate'), ('rod'), ('widget')) g(genre)""", "info"),
    "n_playlists": sql("SELECT count(DISTINCT pid) AS n_playlists FROM info", "info"),
    "playlists_in_scope": sql("""
        SELECT pid, name, num_tracks FROM info WHERE pid IN (
            SELECT pid FROM mem WHERE pos = 0 AND track_uri IN (
                SELECT track_uri FROM mem WHERE pos = 0 GROUP BY 1 ORDER BY count(*) DESC, track_uri LIMIT 10))""",
        "info"),
    "profile_averages": sql("SELECT " + ", ".join(
        r(f"avg(num_{c})", f"avg_{c}") for c in ("followers", "artists", "albums", "tracks")) + " FROM info", "info"),
    "followers_cap": sql(f"SELECT pid, num_followers, {r('t', 'threshold')}, "
                         f"{r('num_followers_capped', 'num_followers_capped')} FROM capped", "capped"),
    "outlier_filtered": sql("SELECT pid, num_followers, num_artists, num_albums, num_tracks, modified_at FROM few", "few"),
    "correlations": sql("SELECT " + ", ".join([
        r("corr(num_artists, num_albums)", "artists_albums"), r("corr(num_tracks, num_albums)", "tracks_albums"),
        r("corr(num_artists, num_tracks)", "artists_tracks"), r("corr(num_followers, num_tracks)", "followers_tracks"),
        r("corr(modified_at, num_followers)", "modified_followers")]) + " FROM kept", "kept"),
    "pair_matrix": sql(" UNION ALL ".join(
        f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {r(f'corr({x}, {y})', 'correlation')} FROM few"
        for x in FEATURES for y in FEATURES), "few"),
    "hist_followers": sql(histogram("capped", "num_followers_capped", 50), "capped"),
    "hist_artists": sql(histogram("info", "num_artists", 30, "WHERE lo + (i + 1) * w >= 1 AND lo + i * w <= 250"), "info"),
    "hist_albums": sql(histogram("info", "num_albums", 30), "info"),
    "hist_tracks": sql(histogram("info", "num_tracks", 30, "WHERE lo + (i + 1) * w >= 1 AND lo + i * w <= 300"), "info"),
    "kde_tracks": sql(kernel("num_tracks", "info"), "info"),
    "kde_all": sql(" UNION ALL ".join(
        [f"SELECT '{c}' AS metric, * FROM ({kernel(c, 'capped')})"
         for c in ("num_followers_capped", "num_artists", "num_albums", "num_tracks")]
        + [f"SELECT 'filtered {c}' AS metric, * FROM ({kernel(c, source)})" for c, source in (
            ("num_followers", "few"), ("num_artists", "few"), ("num_albums", "few"), ("num_tracks", "few"),
            ("modified_days", "(SELECT modified_at / 86400 AS modified_days FROM few)"))]), "capped", "few"),
    "price_quantiles": " UNION ALL ".join(
        summary_quantiles(m, t, 3, p01=0.01, p25=0.25, p50=0.5, p75=0.75, p99=0.99)
        for m, t in (("o_totalprice", "orders"), ("l_extendedprice", "lineitem"))),
    "box_stats": sql(" UNION ALL ".join(
        box(c, c) for c in ("num_followers_capped", "num_artists", "num_albums", "num_tracks")), "capped"),
    "hash_sample": sql("SELECT * FROM pts", "pts"),
    "exact_sample": sql("SELECT pid, name, num_tracks FROM info ORDER BY md5(pid::VARCHAR), pid LIMIT 1000", "info"),
    "exact_sample_each": sql("""
        SELECT num_tracks, pid FROM info
        QUALIFY row_number() OVER (PARTITION BY num_tracks ORDER BY md5(pid::VARCHAR), pid) <= 20""", "info"),
    "joint_marginals": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS metric, * FROM ({histogram('pts', c, 50)})"
        for c in ("num_tracks", "num_followers", "modified_at")), "pts"),
    "hexbin": sql(hexagons("num_tracks"), "pts"),
    "hexbin_modified": sql(hexagons("modified_at"), "pts"),
    "string_index_features": sql("SELECT tid, album_index, artist_index, track_index FROM idx", "idx"),
    "scaled_features": sql("SELECT tid, " + ", ".join(
        r(f"{v}{i + 1}", f"{p}_{k}") for v, k in (("s", "scaled"), ("v", "unit"))
        for i, p in enumerate(("album", "artist", "track", "duration"))) + " FROM vec", "vec"),
    "tfidf_track_text": sql(tfidf("trk", "tid", ["track_name", "album_name", "artist_name"]), "trk"),
    "tfidf_unit": sql(f"SELECT tid, field, token, {r('w', 'weight')} FROM unit", "trk", **UNIT),
    "hashed_term_weights": sql(f"""
        SELECT tid, field, bucket, tf, {r('idf', 'idf')}, {r('tf * idf', 'tfidf')}, terms FROM hashed""", "trk", **HASHED),
    "hashed_track_vectors": sql(f"""
        SELECT tid, field, 48 AS size, count(*) FILTER (tf * idf <> 0) AS n_set, {r('sum(tf * idf)', 'total')},
               {r('sqrt(sum(tf * idf * tf * idf))', 'length')} FROM hashed GROUP BY tid, field""", "trk", **HASHED),
    "model_features": sql(f"""
        SELECT tid, album_index, artist_index, track_index,
               {', '.join(r(f'CASE WHEN l = 0 THEN s{i} ELSE s{i} / l END', f'unit{i}') for i in range(4))}
        FROM (SELECT *, sqrt(s0 * s0 + s1 * s1 + s2 * s2 + s3 * s3) AS l
              FROM (SELECT f.*, {', '.join(f"CASE WHEN hi{i} = lo{i} THEN 0.5 ELSE (least(greatest({c}, lo{i}), hi{i}) - lo{i})"
                                           f"::DOUBLE / (hi{i} - lo{i}) END AS s{i}"
                                           for i, c in enumerate(('album_index', 'artist_index', 'track_index', 'duration_ms')))}
                    FROM f, lim))""", "trk", "spl",
        kn="SELECT * FROM trk WHERE tid IN (SELECT tid FROM spl WHERE NOT holdout)",
        **{f"k{c}": f"SELECT {c}_name AS v, (row_number() OVER (ORDER BY count(*) DESC, {c}_name) - 1)::DOUBLE AS i "
                    f"FROM kn GROUP BY 1" for c in ("album", "artist", "track")},
        f="""SELECT trk.*, """ + ", ".join(f"coalesce(k{c}.i, (SELECT count(*) FROM k{c}))::DOUBLE AS {c}_index"
                                         for c in ("album", "artist", "track")) + " FROM trk " + " ".join(
            f"LEFT JOIN k{c} ON k{c}.v = {c}_name" for c in ("album", "artist", "track")),
        lim="""SELECT 0 AS lo0, (SELECT count(*) - 1 FROM kalbum) AS hi0, 0 AS lo1, (SELECT count(*) - 1 FROM kartist) AS hi1,
                      0 AS lo2, (SELECT count(*) - 1 FROM ktrack) AS hi2, min(duration_ms) AS lo3, max(duration_ms) AS hi3
               FROM kn"""),
    "tfidf_documents": sql(tfidf("documents", "doc_id", ["text"])),
    "playlist_similarity_topk": pairs((6 / 24, 6 / 24, 6 / 24, 1 / 24, 1 / 24, 4 / 24), SHARED_TRACK, 18 / 24),
    "playlist_overlap_topk": pairs((1 / 3, 1 / 3, 1 / 3, 0.0, 0.0, 0.0), SHARED_TRACK, 2 / 3),
    "name_similarity_topk": pairs((0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ALIKE_NAMES, -1.0),
    "similar_playlists_each": sql(f"""
        SELECT pid, l.q AS other_pid, {r('l.ts', 'track_similarity')}, {r('l.rs', 'artist_similarity')},
               {r('l.bs', 'album_similarity')}, {r('l.fs', 'followers_similarity')}, {r('l.ds', 'duration_similarity')},
               {r('l.ns', 'name_similarity')}, {r('l.score', 'final_similarity')}, rank
        FROM (SELECT pid, unnest(list) AS l, generate_subscripts(list, 1) AS rank FROM best)""", "bag", "wrd", **EACH),
    "nearest_playlist_by_name": sql(f"SELECT target_pid, pid, {r('name_similarity', 'name_similarity')} FROM near",
                                    "chal", "wrd", **NAME_PARTS, near=NEAREST),
    "nearest_name_of_every_playlist": sql(f"""
        SELECT c.pid AS target_pid, arg_max(x.pid, (s, -x.pid)) AS pid, {r('max(s)', 'name_similarity')}
        FROM info c JOIN (
            SELECT name_a, h.pid, round(cos, 9) AS s FROM nsim JOIN hold h ON h.name = name_b
            UNION ALL SELECT n.name, f.pid, 0 FROM nam n, (SELECT pid FROM hold ORDER BY pid LIMIT 2) f) x
        ON x.name_a = c.name AND x.pid <> c.pid GROUP BY c.pid""", "info", "wrd", **NAME_PARTS, hold="""
        SELECT name, pid FROM info WHERE num_tracks > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY pid) <= 2"""),
    "similar_tracks": sql(f"""
        SELECT q.tid AS seed_tid, t.tid, t.track_name, t.artist_name,
               {r(f'round({DOT}, 9)', 'cosine_similarity')},
               row_number() OVER (PARTITION BY q.tid ORDER BY round({DOT}, 9) DESC, t.tid) AS rank
        FROM vec q, vec t WHERE q.tid <> t.tid AND q.track_uri IN (
            SELECT track_uri FROM mem WHERE pos = 0 GROUP BY 1 ORDER BY count(*) DESC, track_uri LIMIT 10)
        QUALIFY rank <= 500""", "vec", "mem"),
    "similar_tracks_tfidf": sql(f"""
        SELECT tid, {r('c', 'cosine_similarity')}, row_number() OVER (ORDER BY c DESC, tid) AS rank
        FROM (SELECT v.tid, round((coalesce(dot, 0) + v.d * s.d) / (sqrt(v.e + v.d * v.d) * sqrt(s.e + s.d * s.d)), 9) AS c
              FROM tvec v JOIN (SELECT tvec.* FROM tvec JOIN seed USING (tid)) s ON v.tid <> s.tid
              LEFT JOIN (SELECT x.tid, sum(x.w * y.w) AS dot
                         FROM term x JOIN term y USING (field, token) JOIN seed ON seed.tid = y.tid GROUP BY 1) h
                   ON h.tid = v.tid)
        QUALIFY rank <= 500""", "mem",
        seed="""SELECT tid FROM trk WHERE track_uri = (
            SELECT track_uri FROM mem WHERE pos = 0 GROUP BY 1 ORDER BY count(*) DESC, track_uri LIMIT 1)""",
        term="SELECT tid, field, token, tf * idf AS w FROM ("
             + tfidf("trk", "tid", ["track_name", "album_name", "artist_name"]).replace(r("idf", "idf"), "idf") + ")",
        tvec="""SELECT tid, any_value((duration_ms - lo)::DOUBLE / (hi - lo)) AS d, sum(w * w) AS e
                FROM trk JOIN term USING (tid), (SELECT min(duration_ms) AS lo, max(duration_ms) AS hi FROM trk)
                GROUP BY tid"""),
    "text_similarity_topk": sql(f"""
        SELECT a.tid AS id_a, b.tid AS id_b, {r('round(sum(a.w * b.w), 9)', 'cosine_similarity')}
        FROM unit a JOIN unit b ON a.field = b.field AND a.token = b.token AND a.tid < b.tid AND a.w > 0 AND b.w > 0
        GROUP BY a.tid, b.tid ORDER BY round(sum(a.w * b.w), 9) DESC, 1, 2 LIMIT 1000""", "trk", **UNIT),
    "embedding_neighbours": f"""
        SELECT query_id, item_id, {r('c', 'cosine_similarity')}, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS rank
        FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
                     round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c
              FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
        QUALIFY rank <= 10""",
    "track_similarity_topk": sql(f"""
        SELECT q.tid AS tid_a, t.tid AS tid_b, q.track_name AS track_1, t.track_name AS track_2,
               q.artist_name AS artist_1, t.artist_name AS artist_2, q.album_name AS album_1, t.album_name AS album_2,
               {r(f'round({DOT}, 9)', 'cosine_similarity')}, {r(f'round({DOT}, 9)', 'track_similarity', 3)}
        FROM vec q JOIN vec t ON q.tid < t.tid ORDER BY round({DOT}, 9) DESC, q.tid, t.tid LIMIT 20""", "vec"),
    "embedding_topk": f"""
        SELECT vec_id AS item_id, {r('c', 'cosine_similarity')}, row_number() OVER (ORDER BY c DESC, vec_id) AS rank
        FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 9) AS c
              FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) s WHERE e.vec_id <> s.vec_id)
        QUALIFY rank <= 500""",
    "candidate_pool": sql(f"""
        SELECT {CAT} FROM trk WHERE substr(md5(tid::VARCHAR), 1, 8) < '1999999a'
        OR tid IN (SELECT tid FROM spl WHERE NOT holdout)""", "spl"),
    "continue_seeded": sql(f"SELECT pid, tid, {r('score', 'score')}, rank FROM rec", "vec", "spl", **SEEDED),
    "continue_first_seed": sql(f"SELECT pid, tid, {r('score', 'score')}, rank FROM rec", "vec", "spl", **SEEDED | dict(
        q="""SELECT pid, v1, v2, v3, v4 FROM spl JOIN vec USING (tid) WHERE NOT holdout
             QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pos) = 1""")),
    "continue_seedless": sql(f"SELECT pid, tid, {r('score', 'score')}, rank FROM rec", "vec", "chal", "wrd", **NAME_PARTS,
                             near=NEAREST, own=OWN, q=f"""
        SELECT target_pid AS pid, {MEAN} FROM near JOIN mem USING (pid) JOIN vec USING (tid) GROUP BY 1""",
                             rec=recommended(500)),
    "continue_seeded_lists": sql(f"""
        SELECT pid, count(*) AS n_tracks, md5(string_agg(tid::VARCHAR, ',' ORDER BY rank)) AS tids_md5,
               {r('sum(score)', 'score_sum', 5)}
        FROM rec GROUP BY pid""", "vec", "spl", **dict(SEEDED, rec=recommended(500))),
    "eval_metrics": metrics_sql("(VALUES (1::BIGINT), (5), (10))", "vec", "spl", **SEEDED, labels_of="""
        SELECT DISTINCT pid, tid FROM spl WHERE holdout AND pid IN (SELECT pid FROM own)"""),
    "eval_metrics_all": metrics_sql(
        "(VALUES (1::BIGINT), (10), (100), (500))", "vec", "chal", "wrd", **NAME_PARTS, near=NEAREST, own=OWN, q=f"""
        SELECT pid, {MEAN} FROM (
            SELECT pid, tid FROM spl WHERE NOT holdout
            UNION ALL SELECT target_pid AS pid, tid FROM near JOIN mem USING (pid)) JOIN vec USING (tid) GROUP BY pid""",
        rec=recommended(500), labels_of="SELECT DISTINCT pid, tid FROM spl WHERE holdout"),
}
