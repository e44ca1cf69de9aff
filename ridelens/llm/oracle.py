"""DuckDB texts of the operator queries that SQL can express."""

from ridelens.llm import chat_rotation as chat
from ridelens.llm import curriculum_mix as mixing
from ridelens.llm import line_chunks as lines
from ridelens.llm import merkle_manifest as merkle
from ridelens.llm import pca_tiles as tiles
from ridelens.llm import secret_entropy as secrets
from ridelens.llm.common import WORD


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Patterns and entropy windows, spans located from the pieces between matches."""
    window = secrets.WINDOW
    run = f"[{'A-Za-z0-9+/_=-'}]{{{window},}}"
    located = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' kind, {rank} rank, regexp_extract_all(t, {_quoted(p)}) v,"
        f" regexp_split_to_array(t, {_quoted(p)}) p FROM d"
        for rank, (kind, p) in enumerate(zip(
            secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, run))))
    f = ", ".join(map(str, secrets.micro_bits()))
    allowed = " OR ".join(f"regexp_matches(v, {_quoted(p)})" for p in secrets.ALLOW)
    limits = {k: secrets.largest_sum(b) for k, b in secrets.THRESHOLDS.items()}
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
    m AS ({located}),
    e AS (SELECT doc_id, kind, rank, v, p, unnest(range(1, len(v) + 1)) i FROM m),
    s AS (SELECT doc_id, kind, rank, v[i] v,
            (list_sum(list_transform(p[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::BIGINT a
          FROM e),
    base AS (SELECT doc_id, kind, rank, a, a + length(v) b FROM s
             WHERE kind IN ('access', 'hex') OR kind = 'assign'
               AND length(regexp_extract(v, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.MIN_VALUE}),
    c AS (SELECT doc_id, a, v, row_number() OVER () k,
            CASE WHEN regexp_matches(v, '^[0-9A-Fa-f]+$') THEN {limits['hex']}
                 WHEN regexp_matches(v, '^[0-9A-Za-z]+$') THEN {limits['alnum']}
                 ELSE {limits['base64']} END most
          FROM s WHERE kind = 'entropy' AND regexp_matches(v, '[0-9]') AND NOT ({allowed})),
    w AS (SELECT *, unnest(range(0, length(v) - {window - 1})) o FROM c),
    x AS (SELECT doc_id, a, k, most, o, unnest(string_split(substr(v, o + 1, {window}), '')) ch FROM w),
    n AS (SELECT doc_id, a, k, most, o, ch, count(*) c FROM x GROUP BY ALL),
    h AS (SELECT doc_id, a, k, o FROM n GROUP BY doc_id, a, k, most, o
          HAVING sum(([{f}])[c + 1]) <= most),
    spans AS (SELECT * FROM base UNION ALL
              SELECT doc_id, 'entropy', 3, a + min(o), a + max(o) + {window} FROM h GROUP BY doc_id, a, k),
    g AS (SELECT doc_id,
            count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access,
            count(*) FILTER (kind = 'hex') n_hex, count(*) FILTER (kind = 'entropy') n_entropy,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b)
              FILTER (kind <> 'entropy') base,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) spans
          FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access,
           coalesce(n_hex, 0) n_hex, coalesce(n_entropy, 0) n_entropy,
           sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    FROM d LEFT JOIN g USING (doc_id)"""


def mix_sql() -> str:
    """Targets from the water level; taken words from prefix sums over each source; positions
    from the area below each class' weight line, solved for its right end."""
    weights, limit = list(mixing.WEIGHTS), mixing.REPEAT_LIMIT

    def reached(share: str, schedule) -> str:
        area = sum((v - u) * (a + b) / 2 for (u, a), (v, b) in zip(schedule, schedule[1:]))
        cases, before = [], 0.0
        for (u, a), (v, b) in zip(schedule, schedule[1:]):
            rest = f"({share} * {area!r}::DOUBLE - {before!r}::DOUBLE)"
            root = f"sqrt(greatest({a * a!r}::DOUBLE + {2 * (b - a) / (v - u)!r}::DOUBLE * {rest}, 0::DOUBLE))"
            cases.append((rest, f"{u!r}::DOUBLE + 2 * {rest} / ({a!r}::DOUBLE + {root})"))
            before += (a + b) / 2 * (v - u)
        later = "".join(f" WHEN {rest} >= 0 THEN {time}" for rest, time in reversed(cases[1:]))
        return f"(CASE{later} ELSE {cases[0][1]} END)" if later else cases[0][1]

    def reading(e: int) -> str:
        start = f"({e} * source_size + start)"
        times = " ".join(f"WHEN {k} THEN {reached(f'({start}::DOUBLE / target)', mixing.SCHEDULES[k])}"
                         for k in range(len(weights)))
        return (f"CASE WHEN least(size, floor(target)::BIGINT - {start}) > 0 THEN CASE class {times} END END"
                f" AS position_{e}")
    taken = " + ".join(f"greatest(0, least(size, floor(target)::BIGINT - {e} * source_size - start))"
                       for e in range(limit))
    return f"""
    WITH d AS (SELECT doc_id, source,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT size,
            md5(coalesce(doc_id::VARCHAR, '')) by_id, md5(coalesce(text, '')) by_text FROM documents),
    t AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
    o AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS class FROM t),
    r AS (SELECT *, {weights}[class + 1] weight, {limit} * source_size AS most FROM o),
    q AS (SELECT *, most::DOUBLE / weight ratio FROM r),
    l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) place,
            (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM q),
    g AS (SELECT source, source_size, class, least(most::DOUBLE, weight *
            (SELECT level FROM l WHERE level <= ratio ORDER BY place LIMIT 1)) target FROM l),
    p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY by_id, by_text
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT start FROM d)
    SELECT doc_id, size, source_size, target, ({taken})::BIGINT taken,
           {", ".join(reading(e) for e in range(limit))}
    FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""


def lines_sql() -> str:
    """Chunk boundaries from lagged line hashes; repeated chunk texts by their rank."""
    rolled = " + ".join(["h"] + [f"{lines.BASE ** k} * coalesce(lag(h, {k}) OVER w, 0)"
                                 for k in range(1, lines.WINDOW)])
    return f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) t FROM documents),
    l AS (SELECT doc_id, unnest(t) line, generate_subscripts(t, 1) i FROM d),
    h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT h FROM l),
    r AS (SELECT *, (({rolled}) % {lines.DIVISOR} = 0)::INT stop FROM h
          WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) place FROM r),
    b AS (SELECT doc_id, place, count(*) n, string_agg(line, chr(10) ORDER BY i) body
          FROM c GROUP BY doc_id, place),
    k AS (SELECT *, n >= {lines.MIN_LINES}
            AND row_number() OVER (PARTITION BY body ORDER BY doc_id, place) > 1 gone FROM b)
    SELECT doc_id, count(*) FILTER (gone) removed_chunks,
           coalesce(sum(n) FILTER (gone), 0)::BIGINT removed_lines,
           md5(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '')) text_md5
    FROM k GROUP BY doc_id"""


def rotation_sql() -> str:
    """Rendered turns joined in order; mask spans from running lengths."""
    system = ", ".join(_quoted(r) for r in chat.SYSTEM_ROLES)
    escaped = "replace(replace({}, '<\\', '<\\\\'), '<|', '<\\|')"
    name = f"replace({escaped.format(f'coalesce(role, {_quoted(chat.UNKNOWN)})')}, '|>', '|\\>')"
    end = _quoted(chat.END.rstrip()) + " || chr(10)"
    return f"""
    WITH t AS (SELECT conv_id, turn::BIGINT turn, role, coalesce(text, '') text,
            floor(turn / {chat.PART_TURNS})::BIGINT part FROM conversations),
    p AS (SELECT DISTINCT conv_id, role perspective FROM t WHERE role NOT IN ({system})),
    s AS (SELECT t.conv_id, part, perspective, role = perspective AS trained,
            CASE WHEN role IN ({system}) THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
                 ELSE '<|user ' || {name} || '|>' END head,
            {escaped.format('text')} || {end} body,
            row_number() OVER (PARTITION BY t.conv_id, part, perspective
              ORDER BY turn NULLS LAST, role NULLS LAST, text) i
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    l AS (SELECT *, sum(length(head) + length(body)) OVER (
            PARTITION BY conv_id, part, perspective ORDER BY i)::BIGINT stop FROM s)
    SELECT conv_id, part, perspective, count(*) n_turns, count(*) FILTER (trained) n_trained,
           string_agg(head || body, '' ORDER BY i) rendered,
           coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY i)
             FILTER (trained), '') mask
    FROM l GROUP BY conv_id, part, perspective"""


def manifest_sql() -> str:
    """Trees level by level, each level hashed from the whole one below; siblings by windows."""
    levels = 8             # up to 8^8 leaves a language
    arity = merkle.ARITY

    def written(field: str) -> str:
        return (f"CASE WHEN {field} IS NULL THEN '-' ELSE octet_length(encode({field}::VARCHAR))"
                f" || ':' || {field}::VARCHAR END")

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(written(text if f == 'text' else f) for f in merkle.FIELDS)})"

    # CRC-32 (reflected, polynomial 0xEDB88320) over the bytes of the decimal id
    step = "xor(x >> 1, 3988292384 * (x & 1))"
    crc = ("xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda v: ord(v)::BIGINT), lambda c, b:"
           f" list_reduce(range(8), lambda x, i: {step}, xor(c, b)), 4294967295::BIGINT), 4294967295)")

    def tree(name: str, base: str, up: int) -> str:
        """``name0`` to ``name{up}``: nodes (t, i, h, n), left and right siblings included."""
        run = f"PARTITION BY t, i // {arity} ORDER BY i"
        found = []
        for k in range(up + 1):
            below = base if k == 0 else (
                f"SELECT t, i // {arity} i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END h"
                f" FROM {name}{k - 1} GROUP BY t, i // {arity}")
            found.append(f"""{name}{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') l, coalesce(string_agg(h, '') OVER ({run}
                ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') r, count(*) OVER (PARTITION BY t) n
                FROM ({below}))""")
        return ",\n    ".join(found)

    top_levels = 3         # up to 8^3 languages
    steps = [(f"x{k}", "d") for k in range(levels)] + [(f"y{k}", "s") for k in range(top_levels)]
    joins = " ".join(
        [f"JOIN a{k} x{k} ON x{k}.t = d.t AND x{k}.i = d.i // {arity ** k}" for k in range(levels)]
        + [f"JOIN b0 s ON s.name = d.t JOIN a{levels} u ON u.t = d.t JOIN b{top_levels} z ON true"]
        + [f"JOIN b{k} y{k} ON y{k}.i = s.i // {arity ** k}" for k in range(top_levels)])
    proof = " || ".join(f"CASE WHEN {x}.n > 1 THEN {x}.l || {x}.r ELSE '' END" for x, _ in steps)
    fold = "coalesce(d.found, d.h)"
    folds = []
    for k, (x, _) in enumerate(steps):
        folds.append(f"f{k + 1} AS (SELECT * EXCLUDE (h), CASE WHEN n{k} > 1 THEN sha256(l{k} || h || r{k}) ELSE h END h FROM f{k})")
    carried = ", ".join(f"{x}.n n{k}, {x}.l l{k}, {x}.r r{k}" for k, (x, _) in enumerate(steps))
    lowered = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    return f"""
    WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END t, {leaf('text')} h,
            CASE WHEN coalesce({crc} % {merkle.TAMPER_EVERY} = 0, false) THEN {leaf(lowered)} END found FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 i FROM d),
    {tree('a', 'SELECT t, i, h FROM p', levels)},
    {tree('b', f"SELECT '' t, row_number() OVER (ORDER BY t) - 1 i, h, t AS name FROM a{levels}", 0)},
    {tree('b', '', top_levels).split(',' + chr(10) + '    ', 1)[1]},
    f0 AS (SELECT d.doc_id, d.h leaf, u.h subroot, z.h root, sha256({proof}) proof_sha256, {carried}, {fold} h
           FROM p d {joins}),
    {", ".join(folds)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, h folded_root, h = root verified FROM f{len(steps)}"""


def embeddings_sql() -> str:
    """Every pair of a label compared in double precision; components by closure."""
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
    return f"""
    WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings),
    u AS (SELECT *, len(v) width, sqrt({dot.format('v', 'v')}) size FROM e
          WHERE label IS NOT NULL AND len(v) > 0
            AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))
            AND list_bool_or(list_transform(v, lambda x: x <> 0))),
    k AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b
            ON a.label = b.label AND a.width = b.width AND a.vec_id <> b.vec_id
          WHERE {dot.format('a.v', 'b.v')} / (a.size * b.size) >= {tiles.THRESHOLD}),
    r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
    n AS (SELECT a, count(*) n FROM k GROUP BY a),
    c AS (SELECT a, least(a, min(b)) c FROM r GROUP BY a)
    SELECT vec_id, coalesce(n, 0) n_links, coalesce(c, vec_id) component_id, coalesce(c, vec_id) = vec_id kept
    FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
