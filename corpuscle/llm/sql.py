"""SQL that must give the same rows as a query, where SQL can say it."""

from __future__ import annotations

from corpuscle.llm.mixing import DOCS_PER_BLOCK
from corpuscle.llm.quality_rules import CAPITALS, FENCE, MIN_GROUP, SIGNALS, SYMBOLS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
    CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / {DOCS_PER_BLOCK}.0)::BIGINT AS n_blocks,
    [3.0::DOUBLE, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources),
levelled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
aimed AS (
  SELECT source, source_size, n_blocks,
    least(cap, coalesce(weight * max(CASE WHEN level * weight < cap THEN level END) OVER (), cap)) AS target
  FROM levelled),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM aimed),
placed AS (
  SELECT d.doc_id, d.size, d.source, d.key, d.key % r.n_blocks AS block, r.source_size, r.target, r.passes,
    r.target - r.passes * r.source_size AS rest
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY block, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(size) OVER (PARTITION BY source, block, key) / 2.0::DOUBLE AS reached
  FROM placed)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN reached <= rest AND rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""


def _without(characters: str) -> str:
    quoted = characters.replace("'", "''")
    return f"length(translate(t, '{quoted}', ''))"


def _quality() -> str:
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS signal, {n} AS value FROM measured" for n in SIGNALS)

    def quartiles(name: str, keys: list[str]) -> str:
        group = ", ".join([*keys, "signal"])
        shift = "greatest(bin // 64 - 1, 0)"
        top = f"((bin - 64 * {shift} + 1) << {shift}) - 1"
        return f"""
{name} AS (
  SELECT {group}, max(n) AS docs, min(CASE WHEN reached * 4 >= n THEN {top} END) AS q1, min(CASE WHEN reached * 4 >= n * 3 THEN {top} END) AS q3
  FROM (SELECT *, sum(docs) OVER (PARTITION BY {group} ORDER BY bin) AS reached, sum(docs) OVER (PARTITION BY {group}) AS n
        FROM (SELECT {group}, bin, sum(docs) AS docs FROM sketches GROUP BY {group}, bin))
  GROUP BY {group})"""

    level = lambda q: f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{q} WHEN l.docs >= {MIN_GROUP} THEN l.{q} ELSE a.{q} END"
    least = "CASE o.signal " + " ".join(f"WHEN '{n}' THEN {r}" for n, (_, r) in SIGNALS.items()) + " END"
    limits = ", ".join(
        f"max(CASE WHEN signal = '{n}' THEN {side} END) AS {n}_{side}"
        for n, (sides, _) in SIGNALS.items()
        for side in (("low", "high") if sides == "both" else (sides,))
    )
    failed = ", ".join(
        f"CASE WHEN {n} > {n}_high" + (f" OR {n} < {n}_low" if sides == "both" else "") + f" THEN '{n}' END" for n, (sides, _) in SIGNALS.items()
    )
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(0, 5) AS r(k) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(w) AS n_words, length(translate(t, {spaces}, '')) AS word_chars,
    length(t) - {_without(SYMBOLS)} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(l) AS n_lines, length(t) - {_without(CAPITALS)} AS n_capitals, length(t) - {_without("!")} AS n_marks
  FROM texts LEFT JOIN covered c USING (doc_id)),
measured AS (
  SELECT *, word_chars * 100 // greatest(n_words, 1) AS word_length, n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate,
    n_capitals * 10000 // greatest(word_chars, 1) AS capital_rate, n_marks * 10000 // greatest(n_words, 1) AS mark_rate,
    n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate, n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base),
sketches AS (
  SELECT lang, source, signal, shift * 64 + (value >> shift) AS bin, count(*) AS docs
  FROM (SELECT *, greatest(0, length(bin(value)) - 7) AS shift FROM ({pairs})) GROUP BY ALL),
{quartiles("own", ["lang", "source"])}, {quartiles("by_lang", ["lang"])}, {quartiles("overall", [])},
fenced AS (
  SELECT o.lang, o.source, o.signal, {level("q1")} - {FENCE} * greatest({level("q3")} - {level("q1")}, {least}) AS low,
    {level("q3")} + {FENCE} * greatest({level("q3")} - {level("q1")}, {least}) AS high
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.signal = l.signal JOIN overall a ON o.signal = a.signal),
limits AS (SELECT lang, source, {limits} FROM fenced GROUP BY lang, source),
judged AS (
  SELECT m.*, list_filter([{failed}], lambda x: x IS NOT NULL) AS failures
  FROM measured m JOIN limits f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND len(failures) = 0 AS kept, array_to_string(failures, ',') AS failed
FROM judged
"""


QUALITY = _quality()

PHRASES = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sized AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM listed),
grams AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS p
  FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM sized WHERE len(ws) >= k)),
f AS (SELECT lang, k, p, count(*) AS c FROM grams GROUP BY ALL),
cand AS (SELECT lang, k, p, c AS a, string_split(p, ' ') AS ws FROM f WHERE k >= 2 AND c >= 30),
cuts AS (SELECT lang, p, k, a, ws, unnest(range(1, k)) AS cut FROM cand),
judged AS (
  SELECT cuts.lang, cuts.p, cuts.a, cut, x.c AS l, y.c AS r, (2000000::HUGEINT * cuts.a) // (x.c::HUGEINT + y.c) AS score
  FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.k = cut AND x.p = array_to_string(ws[1:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - cut AND y.p = array_to_string(ws[cut + 1:cuts.k], ' ')),
lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
held AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS p, max(a) AS longer
  FROM (SELECT lang, ws, a, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM cand WHERE k > 2))
  GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, p) WHERE longer IS NULL OR longer::HUGEINT * 100 < lowest.a::HUGEINT * 80),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase,
  a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
