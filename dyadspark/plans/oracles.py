"""DuckDB SQL for the registered queries, written from the definitions of the operators."""

from __future__ import annotations

from dyadspark.constants import BACKCHANNELS, RESPONSE_TARGETS

_LEXICON = ", ".join("'" + x.replace("'", "''") + "'" for x in BACKCHANNELS)
_LINE = r"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_WORDS = r"""
t AS (SELECT conv_id, turn, role, (conv_id + turn) % 7 = 3 AS injected, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'yeah.' ELSE coalesce(text, '') END AS text FROM conversations WHERE role <> 'system'),
w0 AS (SELECT * EXCLUDE (text), list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws FROM t),
w1 AS (SELECT * EXCLUDE (ws), unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w0),
w2 AS (SELECT *, 30 * length(word) + 40 AS dur, 30 * length(word) + 40 + CASE WHEN NOT word LIKE '%.' THEN 20 WHEN (conv_id + turn + i) % 5 = 0 THEN 1400 ELSE 350 END AS step,
  coalesce(sum(CASE WHEN word LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seg FROM w1),
w3 AS (SELECT *, sum(step) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS ran FROM w2),
tt AS (SELECT conv_id, turn, sum(step) AS tot FROM w2 GROUP BY ALL),
oo AS (SELECT conv_id, turn, sum(tot + (conv_id * 7 + turn * 389) % 1500 - 200) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - tot AS off FROM tt),
words AS (SELECT conv_id AS interaction, 'P' || (2 * conv_id + CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS participant, turn, seg AS seg_idx, i AS word_idx, word, (off + ran - step)::BIGINT AS s, (off + ran - step + dur)::BIGINT AS e, injected FROM w3 JOIN oo USING (conv_id, turn)),
vad AS (SELECT interaction, participant, CASE WHEN injected THEN max(e) + 300 ELSE min(s) - 60 END AS s, CASE WHEN injected THEN max(e) + 700 ELSE max(e) + 80 END AS e
  FROM words GROUP BY interaction, participant, turn, seg_idx, injected HAVING (interaction + turn + seg_idx) % 11 <> 0),
ev AS (SELECT interaction, participant, turn, seg_idx, min(s) AS s, arg_max(e, (s, word_idx)) AS e FROM words GROUP BY ALL),
evb AS (SELECT *, CASE WHEN s - max(e) OVER w <= 1000 THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY interaction, participant ORDER BY s, turn, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
evi AS (SELECT *, sum(brk) OVER (PARTITION BY interaction, participant ORDER BY s, turn, seg_idx ROWS UNBOUNDED PRECEDING) AS island FROM evb),
turns AS (SELECT interaction, participant, island, min(s) AS s, max(e) AS e, count(*) AS n_events FROM evi GROUP BY ALL),
tw AS (SELECT evi.interaction, evi.participant, evi.island, words.s, words.e, words.turn, words.seg_idx, words.word_idx, words.word FROM words JOIN evi USING (interaction, participant, turn, seg_idx)),
ttext AS (SELECT interaction, participant, island, string_agg(word, ' ' ORDER BY s, turn, seg_idx, word_idx) AS transcript, count(*) AS n_words FROM tw GROUP BY ALL),
vb AS (SELECT *, CASE WHEN s - max(e) OVER w <= 1000 THEN 0 ELSE 1 END AS brk FROM vad WINDOW w AS (PARTITION BY interaction, participant ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
vi AS (SELECT *, sum(brk) OVER (PARTITION BY interaction, participant ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM vb),
vm AS (SELECT interaction, participant, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM vi GROUP BY interaction, participant, island),
touch AS (SELECT t.interaction, t.participant, t.island, min(v.s) AS rs, max(v.e) AS re FROM turns t JOIN vm v USING (interaction, participant) WHERE v.e >= t.s AND v.s <= t.e GROUP BY ALL),
near AS (SELECT t.interaction, t.participant, t.island, arg_min(v.s, (greatest(t.s - v.e, v.s - t.e), v.s)) AS rs, arg_min(v.e, (greatest(t.s - v.e, v.s - t.e), v.s)) AS re FROM turns t JOIN vm v USING (interaction, participant) WHERE greatest(t.s - v.e, v.s - t.e) <= 500 GROUP BY ALL),
refined AS (SELECT t.*, coalesce(a.rs, b.rs) AS rs, coalesce(a.re, b.re) AS re FROM turns t LEFT JOIN touch a USING (interaction, participant, island) LEFT JOIN near b USING (interaction, participant, island)),
norm AS (SELECT interaction, participant, island, lower(regexp_replace(trim(transcript), '\s+', ' ', 'g')) AS txt FROM ttext),
fewbad AS (SELECT interaction, participant, island, count(*) AS n, count(*) FILTER (lower(word) NOT IN (LEXICON)) AS others FROM tw GROUP BY ALL),
bc AS (SELECT interaction, participant, island, txt IN (LEXICON) OR (n <= 3 AND others = 0) AS backchannel FROM norm JOIN fewbad USING (interaction, participant, island)),
line AS (SELECT r.*, b.backchannel, row_number() OVER o AS place, lag(r.participant) OVER o AS pp, lag(r.island) OVER o AS pisland, lag(r.s) OVER o AS ps0, lag(r.e) OVER o AS pe0, lag(rs) OVER o AS prs, lag(re) OVER o AS pre, lag(b.backchannel) OVER o AS pbc
  FROM refined r JOIN bc b USING (interaction, participant, island) WINDOW o AS (PARTITION BY r.interaction ORDER BY r.s, r.e, r.participant)),
cut AS (SELECT *, greatest(prs, pre - 15000) AS p_s, pre AS p_e, rs AS r_s, least(re, rs + 15000) AS r_e FROM line WHERE pp <> participant AND NOT backchannel AND NOT pbc AND rs IS NOT NULL AND prs IS NOT NULL),
kept AS (SELECT *, greatest(0, r_s - p_e) AS latency, greatest(0, p_e - r_s) AS overlap FROM cut WHERE p_e - p_s >= 3000 AND r_e - r_s >= 3000 AND r_s - p_e <= 1000 AND p_e - r_s <= 250),
pr AS (SELECT *, row_number() OVER (PARTITION BY interaction ORDER BY place) AS turn_index FROM kept),
pw AS (SELECT pr.interaction, pr.turn_index, coalesce(string_agg(word, ' ' ORDER BY tw.s, tw.turn, tw.seg_idx, tw.word_idx), '') AS txt, count(word)::INT AS n FROM pr LEFT JOIN tw ON tw.interaction = pr.interaction AND tw.participant = pr.pp AND tw.island = pr.pisland AND tw.s >= p_s AND tw.e <= p_e GROUP BY ALL),
rw AS (SELECT pr.interaction, pr.turn_index, coalesce(string_agg(word, ' ' ORDER BY tw.s, tw.turn, tw.seg_idx, tw.word_idx), '') AS txt, count(word)::INT AS n FROM pr LEFT JOIN tw ON tw.interaction = pr.interaction AND tw.participant = pr.participant AND tw.island = pr.island AND tw.s >= r_s AND tw.e <= r_e GROUP BY ALL),
pairs AS (SELECT pr.interaction || '|' || pp || '|' || participant || '|' || lpad(turn_index::VARCHAR, greatest(4, length(turn_index::VARCHAR))::INT, '0') AS pair_id, pr.interaction, least(pp, participant) || '|' || greatest(pp, participant) AS dyad_id, pp AS prompt_participant_id, participant AS response_participant_id, turn_index::INT AS turn_index, p_s AS prompt_start, p_e AS prompt_end, r_s AS response_start, r_e AS response_end, latency, overlap, pw.txt AS prompt_transcript, rw.txt AS response_transcript, pw.n AS prompt_word_count, rw.n AS response_word_count
  FROM pr JOIN pw USING (interaction, turn_index) JOIN rw USING (interaction, turn_index))
""".replace("LEXICON", _LEXICON)


def _w(select: str) -> str:
    return f"WITH {_WORDS} {select}"


_EVENTS = "iv AS (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + round(coalesce(value, 0) * 60000)::BIGINT AS e FROM events), ok AS (SELECT * FROM iv WHERE e > s)"


def _merged(op: str) -> str:
    return f"""WITH {_EVENTS}, b AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s {_LINE}) {op} 3600000 THEN 0 ELSE 1 END AS brk FROM ok),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n_merged FROM i GROUP BY user_id, island"""


_TEMPO = """g AS (SELECT interaction, participant, island, s - lag(e) OVER (PARTITION BY interaction, participant, island ORDER BY s, turn, seg_idx, word_idx) AS gap FROM tw),
a AS (SELECT interaction, participant, island, count(*) AS n, coalesce(sum(gap) FILTER (gap >= 200), 0)::DOUBLE AS p, count(*) FILTER (gap >= 200) AS np FROM g GROUP BY ALL)"""

_FRAMES = """f AS (SELECT vec_id AS segment_id, unnest(range(0, 7)) AS frame_idx, embedding FROM embeddings WHERE len(embedding) = 64),
x AS (SELECT segment_id, frame_idx::INT AS frame_idx, (frame_idx * 8 + 8) / 64.0::DOUBLE AS center, sqrt(list_sum(list_transform(embedding[frame_idx * 8 + 1:frame_idx * 8 + 16], lambda v: v::DOUBLE * v::DOUBLE)) / 16 + 1e-6) AS rms FROM f)"""
_SPEECH = (
    _FRAMES
    + """, th AS (SELECT segment_id, greatest(quantile_cont(rms, 0.65) * 0.35, max(rms) * 0.05, 1e-4) AS thr FROM x GROUP BY 1),
l AS (SELECT x.*, rms >= thr AS loud, lead(center) OVER (PARTITION BY segment_id ORDER BY frame_idx) AS nxt, coalesce(lag(rms >= thr) OVER (PARTITION BY segment_id ORDER BY frame_idx), false) AS was FROM x JOIN th USING (segment_id)),
r AS (SELECT *, sum(CASE WHEN loud AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM l),
rr AS (SELECT segment_id, run, greatest(0, min(center) - 0.125) AS s, CASE WHEN last(nxt ORDER BY frame_idx) IS NULL THEN 1.0 ELSE least(1.0, last(nxt ORDER BY frame_idx) + 0.125) END AS e FROM r WHERE loud GROUP BY ALL),
rb AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY segment_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.2 THEN 0 ELSE 1 END AS brk FROM rr),
ri AS (SELECT *, sum(brk) OVER (PARTITION BY segment_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM rb),
sp AS (SELECT segment_id, min(s)::DOUBLE AS s, max(e)::DOUBLE AS e FROM ri GROUP BY segment_id, island)"""
)
_REC = """re AS (SELECT '/rec/' || coalesce(label::VARCHAR, 'none') || '.wav' AS path, vec_id, len(embedding) AS n, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT - len(embedding) AS off, CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda v: v * 0) ELSE embedding END AS v FROM embeddings WHERE embedding IS NOT NULL),
rn AS (SELECT path, sum(n)::BIGINT AS n FROM re GROUP BY 1),
rx AS (SELECT path, off + unnest(range(0, n)) AS pos, unnest(v)::DOUBLE AS x FROM re)"""
_RECFRAMES = (
    _REC
    + """, fi AS (SELECT path, n, (n / 64.0)::DOUBLE AS length, CASE WHEN n < 16 THEN 1 ELSE (n - 16) // 8 + 1 END AS many, least(n, 16) AS width FROM rn WHERE n > 0),
fx AS (SELECT path, unnest([pos // 8, pos // 8 - 1]) AS i, x FROM rx),
x AS (SELECT path, i::INT AS frame_idx, (i * 8 + any_value(width) / 2) / 64.0::DOUBLE AS center, sqrt(sum(x * x) / any_value(width) + 1e-6) AS rms, any_value(length) AS length, any_value(many) AS many FROM fx JOIN fi USING (path) WHERE i >= 0 AND i < many GROUP BY path, i)"""
)
_RECSPEECH = (
    _RECFRAMES
    + """, th AS (SELECT path, greatest(quantile_cont(rms, 0.65) * 0.35, max(rms) * 0.05, 1e-4) AS thr FROM x GROUP BY 1),
l AS (SELECT x.*, rms >= thr AS loud, lead(center) OVER o AS nxt, coalesce(lag(rms >= thr) OVER o, false) AS was FROM x JOIN th USING (path) WINDOW o AS (PARTITION BY path ORDER BY frame_idx)),
r AS (SELECT *, sum(CASE WHEN loud AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM l),
rr AS (SELECT path, run, greatest(0, min(center) - 0.125) AS s, CASE WHEN last(nxt ORDER BY frame_idx) IS NULL THEN any_value(length) ELSE least(any_value(length), last(nxt ORDER BY frame_idx) + 0.125) END AS e FROM r WHERE loud GROUP BY ALL),
rb AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY path ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.2 THEN 0 ELSE 1 END AS brk FROM rr),
ri AS (SELECT *, sum(brk) OVER (PARTITION BY path ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM rb),
sp AS (SELECT path, round(min(s) * 64)::BIGINT AS s, round(max(e) * 64)::BIGINT AS e FROM ri GROUP BY path, island)"""
)
# every sample of the speech, numbered along the speech alone
_VOICE = (
    _RECSPEECH
    + """, ck AS (SELECT *, sum(e - s) OVER (PARTITION BY path ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT - (e - s) AS ran FROM sp),
tk AS (SELECT path, s, ran, unnest(range(s, e)) AS pos FROM ck),
ch AS (SELECT path, (ran + pos - s) // 960 AS chunk, count(*) AS n, avg(x * x) AS arousal, avg(x) AS valence, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS up FROM tk JOIN rx USING (path, pos) GROUP BY ALL HAVING count(*) >= 192),
cm AS (SELECT path, avg(arousal) AS arousal, avg(valence) AS valence, avg(n) AS dominance, count(*) AS chunks, avg(up) AS up FROM ch GROUP BY 1),
ss AS (SELECT path, sum(e - s) / 64.0::DOUBLE AS speech FROM sp GROUP BY 1)"""
)
_PATHS = """p AS (SELECT o_orderkey, o_custkey, 'data/' || CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' WHEN o_orderkey % 10 < 9 THEN 'test' ELSE 'other' END || '/V' || o_orderkey % 3 || '_S' || o_custkey || '_I' || o_orderkey || '_P' || o_custkey || '.wav' AS path FROM orders)"""
_REL = """rel AS (SELECT 'V' AS vendor_id, c_nationkey AS session_id, c_custkey AS place, CASE WHEN c_custkey % 11 = 0 THEN 'stranger' ELSE c_mktsegment END AS relationship, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'stranger' ELSE lower(c_mktsegment) END AS detail FROM customer),
nrel AS (SELECT *, CASE WHEN trim(detail) IN ('', 'stranger') OR relationship = 'stranger' THEN 'UNKNOWN' ELSE trim(detail) END AS nd FROM rel)"""
_TABLES = """one AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_quantity) AS quantity, min(l_extendedprice) AS price, min(l_tax) AS tax FROM lineitem GROUP BY ALL),
lt AS (SELECT l_orderkey, l_linenumber, part, quantity, price FROM one WHERE part % 10 <> 0),
rt AS (SELECT l_orderkey, l_linenumber, part, quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS quantity, tax FROM one WHERE part % 7 <> 0)"""
_NUMBER = "regexp_replace(printf('%.6f', {0}), '(\\.\\d+?)0+$', '\\1')"
_MISMATCH = f"""WITH {_TABLES}, m AS (SELECT count(*) AS compared, count(*) FILTER (lt.part IS DISTINCT FROM rt.part) AS a, count(*) FILTER (lt.quantity IS DISTINCT FROM rt.quantity) AS b FROM lt JOIN rt USING (l_orderkey, l_linenumber))"""

_CAND = r"""base AS (SELECT doc_id AS k, (['original', 'model/a', 'model|b', 'model_c'])[(doc_id % 4 + 1)::INT] AS model_name, 'test' AS split, lang AS source_style, doc_id // 4 AS conv, 'dialog_' || (doc_id // 4) % 97 || '_' || doc_id // 4 AS stem, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'audio/' || doc_id || '.wav' END AS answer, coalesce(text, '') AS said FROM documents WHERE doc_id IS NOT NULL),
inp AS (SELECT split, source_style, stem, arg_max(struct_pack(q := CASE WHEN conv % 4 = 0 THEN '' ELSE ' P5C: first ' || conv || ' P6D: last' END, c := 'c' || conv), k) AS v FROM base WHERE conv % 3 <> 0 GROUP BY ALL),
asr AS (SELECT model_name, split, source_style, CASE WHEN k % 2 = 0 THEN answer ELSE 'other/' || k || '.wav' END AS path, trim(CASE WHEN k % 16 = 0 THEN NULL WHEN k % 8 = 0 THEN ' ' ELSE 'heard it''s ' || k END) AS txt, 2 * k AS place FROM base JOIN labels ON labels.doc_id = k
  UNION ALL SELECT model_name, split, source_style, 'other/' || k || '.wav', 'elsewhere ' || k, 2 * k + 1 FROM base JOIN labels ON labels.doc_id = k WHERE k % 8 = 0),
ap AS (SELECT model_name, split, source_style, path, arg_max(struct_pack(t := txt), place) AS v FROM asr GROUP BY ALL),
an AS (SELECT model_name, split, source_style, regexp_extract(path, '([^/]*)$', 1) AS name, arg_max(struct_pack(t := txt), place) AS v FROM asr GROUP BY ALL),
cat AS (SELECT path, max(d) AS d FROM (SELECT '/root/' || answer AS path, (k % 25 + 1)::DOUBLE AS d FROM base WHERE k % 19 <> 0 UNION ALL SELECT '/root/questions/' || stem || '.wav', (conv % 25 + 1)::DOUBLE FROM base WHERE conv % 23 <> 0) GROUP BY 1),
j AS (SELECT b.*, coalesce(CASE WHEN ap.v IS NOT NULL THEN ap.v.t ELSE an.v.t END, '') AS asr_text, i.v IS NOT NULL AS hit, trim(CASE WHEN i.v IS NOT NULL THEN i.v.q ELSE 'P1A: out ' || said END) AS q, trim(CASE WHEN k % 5 = 0 THEN '|P7|P8' ELSE 'P3|P4' END) AS speakers, trim('P2B: ' || said || ' ') AS meta, '/root/questions/' || b.stem || '.wav' AS ppath, CASE WHEN answer = '' THEN NULL ELSE '/root/' || answer END AS rpath
  FROM base b LEFT JOIN inp i USING (split, source_style, stem) LEFT JOIN ap ON ap.model_name = b.model_name AND ap.split = b.split AND ap.source_style = b.source_style AND ap.path = b.answer
  LEFT JOIN an ON an.model_name = b.model_name AND an.split = b.split AND an.source_style = b.source_style AND an.name = regexp_extract(b.answer, '([^/]*)$', 1)),
m AS (SELECT j.*, cp.d AS pd, cr.d AS rd, CASE WHEN answer = '' THEN 'MISSING_RESPONSE_AUDIO_PATH' WHEN cp.d IS NULL THEN 'MISSING_PROMPT_AUDIO_FILE' WHEN cr.d IS NULL THEN 'MISSING_RESPONSE_AUDIO_FILE' ELSE 'OK' END AS status, CASE WHEN asr_text <> '' THEN asr_text ELSE meta END AS resp, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 3 = 1 THEN 0.5 ELSE -0.25 END::DOUBLE AS st, list_filter(list_transform(string_split(speakers, '|'), lambda x: trim(x)), lambda x: x <> '') AS sp
  FROM j LEFT JOIN cat cp ON cp.path = ppath LEFT JOIN cat cr ON cr.path = rpath)"""
_CANDID = "replace(replace(model_name, '|', '_'), '/', '_') || '|' || split || '|' || source_style || '|' || stem || '|' || k"
_LASTP = r"coalesce(list_last(regexp_extract_all({0}, '(?:^|[^\p{{L}}\p{{N}}_])(P[0-9A-Z]+):', 1)), '')"
_FIRSTP = r"regexp_extract({0}, '(?:^|[^\p{{L}}\p{{N}}_])(P[0-9A-Z]+):', 1)"
_WORDCOUNT = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_''\p{{Pc}}]*[\p{{L}}\p{{N}}\p{{M}}_\p{{Pc}}][\p{{L}}\p{{N}}\p{{M}}_''\p{{Pc}}]*'))::INT"
_PRED = "pd AS (SELECT l_returnflag AS condition, CASE WHEN l_linestatus = 'O' THEN 'natural_test' ELSE 'probe' END AS dataset, 't' || l_linenumber AS target, l_quantity AS y, l_quantity + l_discount * 10 AS mu, 1 + l_tax AS sigma FROM lineitem), ll AS (SELECT *, -0.5 * ln(2 * pi()) - ln(sigma) - 0.5 * pow((y - mu) / sigma, 2) AS ll FROM pd)"
_SCORES = "avg(pow(y - mu, 2)) AS mse, CASE WHEN var_pop(y) > 0 THEN 1 - avg(pow(y - mu, 2)) / var_pop(y) END AS r2"
_DLL = "avg(ll) FILTER (dataset = 'natural_test') AS a, avg(ll) FILTER (dataset = 'probe') AS b"
_RATE = "(1 + (floor(coalesce(value, 0))::BIGINT + {0}) % 5)::DOUBLE"
_CLIPS = f"rt AS (SELECT event_id % 300 AS clip_id, event_type AS condition, {', '.join(_RATE.format(i) + f' AS v{i}' for i in range(5))} FROM events WHERE event_id % 11 <> 0), cl AS (SELECT clip_id, condition, avg(v0) AS overall, (avg(v1) + avg(v2) + avg(v3) + avg(v4)) / 4 AS style FROM rt GROUP BY ALL)"
_ROLES = "rv AS (SELECT vec_id // 2 AS merge_key, CASE WHEN vec_id % 2 = 0 THEN 'prompt' ELSE 'response' END AS role, CASE WHEN vec_id % 13 = 0 THEN 'EMPTY_AUDIO' ELSE 'OK' END AS status0, embedding FROM embeddings), ra AS (SELECT *, CASE WHEN status0 = 'OK' AND max(CASE WHEN status0 <> 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY merge_key) = 1 THEN 'SKIPPED_PAIR_FAILURE' ELSE status0 END AS status FROM rv)"

_THIRDS = "th AS (SELECT label, " + ", ".join(f"list_avg(list_transform(embedding[(len(embedding) * {i} // 3) + 1:(len(embedding) * {i + 1} // 3)], lambda v: v::DOUBLE)) AS t{i}" for i in range(3)) + " FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0)"
_PROFILES = """pu AS (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL), pp AS (SELECT label, pos, avg(x) AS p FROM pu GROUP BY ALL),
pb AS (SELECT label, arg_max(pos, (p, -pos)) AS pos, max(p) AS best FROM pp GROUP BY 1), pf AS (SELECT label, a.age, CASE WHEN pos = 0 THEN 'female' ELSE 'male' END AS gender, best FROM pb JOIN (SELECT label, avg(embedding[1]::DOUBLE) * 100 AS age FROM embeddings WHERE label IS NOT NULL GROUP BY 1) a USING (label))"""

_DYADS = f"""WITH {_PATHS} SELECT o_orderkey::VARCHAR AS interaction_id, o_custkey::VARCHAR AS session_id, 'P' || o_custkey AS participant1_id, 'P' || (o_custkey + 1) AS participant2_id, (o_custkey + 1)::VARCHAR AS p2_participant, least('P' || o_custkey, 'P' || (o_custkey + 1)) || '|' || greatest('P' || o_custkey, 'P' || (o_custkey + 1)) AS dyad_id,
CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'test' END AS split, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' WHEN o_orderkey % 10 < 9 THEN 'test' END AS p1_source_split FROM p"""
_NATURAL = f"""SELECT * FROM (WITH {_REL}, one AS (SELECT session_id, arg_max(relationship, place) AS relationship, arg_max(nd, place) AS nd FROM nrel GROUP BY 1),
rg AS (SELECT pr.interaction, pr.turn_index, tw.s - lag(tw.e) OVER (PARTITION BY pr.interaction, pr.turn_index ORDER BY tw.s, tw.turn, tw.seg_idx, tw.word_idx) AS gap, word FROM pr LEFT JOIN tw ON tw.interaction = pr.interaction AND tw.participant = pr.participant AND tw.island = pr.island AND tw.s >= r_s AND tw.e <= r_e),
ra AS (SELECT interaction, turn_index, count(word) AS n, coalesce(sum(gap) FILTER (gap >= 200), 0)::DOUBLE AS p FROM rg GROUP BY ALL)
SELECT pair_id, (pairs.interaction % 30)::VARCHAR AS session_id, pairs.interaction::VARCHAR AS interaction_id, dyad_id, prompt_participant_id, response_participant_id, pairs.turn_index, '/c' || pairs.interaction || '_' || prompt_participant_id || '.wav' AS source_wav_path_prompt, '/c' || pairs.interaction || '_' || response_participant_id || '.json' AS source_json_path_response,
prompt_start AS prompt_start_s, prompt_end AS prompt_end_s, prompt_end - prompt_start AS prompt_duration_s, response_start AS response_start_s, response_end AS response_end_s, latency AS latency_s, overlap AS overlap_s, prompt_transcript, response_transcript, prompt_word_count, response_word_count,
coalesce(relationship, 'UNKNOWN') AS relationship, coalesce(nd, 'UNKNOWN') AS relationship_detail, CASE WHEN relationship IS NULL THEN 'MISSING_RELATIONSHIP_METADATA' ELSE 'OK' END AS status_relationship, 'OK' AS status_pair, 'train' AS source_dataset_split, 'train' AS split, 'source_split' AS split_unit,
CASE WHEN ra.n >= 2 THEN round(60000.0::DOUBLE * ra.n / (response_end - response_start), 6) END AS response_speech_rate_local, CASE WHEN ra.n >= 2 THEN round(ra.p / (response_end - response_start), 6) END AS response_pause_ratio_local, CASE WHEN ra.n >= 2 THEN 'OK' ELSE 'TOO_FEW_WORDS_FOR_TEMPORAL' END AS status_response_temporal,
concat_ws('|', (pairs.interaction % 30)::VARCHAR, pairs.interaction::VARCHAR, dyad_id, prompt_participant_id, response_participant_id, pairs.turn_index::VARCHAR, {", ".join(_NUMBER.format(c + "::DOUBLE") for c in ("prompt_start", "prompt_end", "response_start", "response_end"))}) AS merge_key
FROM pairs JOIN ra USING (interaction, turn_index) LEFT JOIN one ON one.session_id = pairs.interaction % 30)"""

SQL = {
    "dyads_file": _DYADS,
    "relationships_file": f"WITH {_REL} SELECT vendor_id, session_id::VARCHAR AS session_id, arg_max(relationship, place) AS relationship, arg_max(trim(detail), place) AS relationship_detail FROM rel GROUP BY ALL",
    "recordings_file": _w("""SELECT w.interaction, w.participant, n_words, spoken, n_segments, coalesce(n_vad, 0) AS n_vad FROM (SELECT interaction, participant, count(*) AS n_words, round(sum(e - s) / 1000.0::DOUBLE, 3) AS spoken, count(DISTINCT turn * 1000 + seg_idx) AS n_segments FROM words GROUP BY ALL) w
LEFT JOIN (SELECT interaction, participant, count(*) AS n_vad FROM vad GROUP BY ALL) v USING (interaction, participant)"""),
    "natural_pairs": _w(_NATURAL),
    "recordings_violations": _w("""SELECT * FROM (WITH own AS (SELECT DISTINCT interaction, participant FROM words), nv AS (SELECT interaction, participant, count(*) AS n FROM vad GROUP BY ALL),
o AS (SELECT own.*, coalesce(n, 0) AS n, interaction % 11 AS k, interaction || '|' || participant AS recording FROM own LEFT JOIN nv USING (interaction, participant))
SELECT 'BROKEN_DOCUMENT' AS reason, NULL::VARCHAR AS recording, NULL::VARCHAR AS place FROM o WHERE k = 0
UNION ALL SELECT 'MISSING_FIELD', recording, 'metadata:vad' FROM o WHERE k = 1 OR (k <> 0 AND n = 0)
UNION ALL SELECT 'WRONG_TYPE', recording, 'segment 0 word 0: start' FROM o WHERE k = 3
UNION ALL SELECT CASE WHEN k = 2 THEN 'INVERTED_BOUND' ELSE 'NULL_BOUND' END, recording, 'vad ' || unnest(range(0, n)) FROM o WHERE k IN (2, 4))"""),
    "natural_pairs_pitch": _w("""SELECT * FROM (WITH fr AS (SELECT interaction, participant, s, CASE WHEN word_idx % 4 = 0 THEN 0 ELSE 80 + (length(word) * 13 + word_idx * 7) % 200 END::DOUBLE AS f0 FROM words),
sg AS (SELECT pair_id, interaction, 'prompt' AS role, prompt_participant_id AS participant, prompt_start AS a, prompt_end AS b FROM pairs UNION ALL SELECT pair_id, interaction, 'response', response_participant_id, response_start, response_end FROM pairs),
fi AS (SELECT pair_id, role, f0 FROM sg LEFT JOIN fr ON fr.interaction = sg.interaction AND fr.participant = sg.participant AND s >= a AND s < b),
fq AS (SELECT pair_id, role, count(f0) AS n, count(*) FILTER (f0 > 0) AS voiced, quantile_cont(f0, 0.1) FILTER (f0 > 0) AS lo, quantile_cont(f0, 0.9) FILTER (f0 > 0) AS hi FROM fi GROUP BY ALL),
ft AS (SELECT pair_id, role, avg(f0) AS m, stddev_pop(f0) AS sd FROM fi JOIN fq USING (pair_id, role) WHERE f0 > 0 AND f0 BETWEEN lo AND hi GROUP BY ALL),
fs AS (SELECT pair_id, role, round(m, 6) AS m, round(sd, 6) AS sd, round(hi - lo, 6) AS r, round(CASE WHEN n > 0 THEN voiced / n ELSE 0 END::DOUBLE, 6) AS v, CASE WHEN n = 0 THEN 'NO_PITCH_FRAMES' WHEN voiced = 0 THEN 'NO_VOICED_FRAMES' WHEN voiced / n < 0.05 THEN 'LOW_VOICED_RATIO' ELSE 'OK' END AS st FROM fq LEFT JOIN ft USING (pair_id, role))
SELECT p.pair_id, p.m AS prompt_f0_mean, p.sd AS prompt_f0_sd, p.r AS prompt_f0_range, p.v AS prompt_voiced_ratio, r.m AS response_f0_mean, r.sd AS response_f0_sd, r.r AS response_f0_range, r.v AS response_voiced_ratio, p.st AS status_prompt_prosody, r.st AS status_response_prosody
FROM fs p JOIN fs r ON p.pair_id = r.pair_id AND p.role = 'prompt' AND r.role = 'response')"""),
    "natural_violations": _w("""SELECT * FROM (WITH c AS (SELECT DISTINCT interaction AS i FROM words), v AS (SELECT interaction AS i, '/c' || interaction || '_' || participant || '.json' AS path, CASE WHEN interaction % 17 = 0 THEN e + 5 WHEN interaction % 29 <> 0 THEN s END AS s, e FROM vad WHERE interaction % 13 <> 0),
here AS (SELECT DISTINCT '/c' || interaction || '_' || participant || '.json' AS path FROM words WHERE interaction % 13 <> 0),
a AS (SELECT 'unique_key' AS "check", i::VARCHAR AS key, '2 rows' AS detail FROM c WHERE i % 23 = 0
UNION ALL SELECT 'recording', path, 'missing' FROM (SELECT '/c' || i || '_P' || (2 * i + unnest([0, 1])) || '.json' AS path, i FROM c), range(0, 2) AS t(x) WHERE (x = 0 OR i % 23 = 0) AND path NOT IN (SELECT path FROM here)
UNION ALL SELECT 'dyad_consistent', i::VARCHAR, 'vendor' FROM c, range(0, 2) AS t(x) WHERE i % 19 = 0 AND (x = 0 OR i % 23 = 0)
UNION ALL SELECT 'interval', path, CASE WHEN s IS NULL THEN 'null bound' ELSE 'inverted' END FROM v WHERE s IS NULL OR e < s)
SELECT "check", key, detail, count(*) AS n FROM a GROUP BY ALL)"""),
    "probe_pairs": _w("""SELECT * FROM (WITH it AS (SELECT DISTINCT interaction, 'row_' || interaction || '_p1_P' || 2 * interaction || '_p2_P' || (2 * interaction + 1) AS name, CASE WHEN interaction % 3 = 0 THEN 'synth' ELSE 'orig' END AS a, CASE WHEN interaction % 5 = 0 THEN 'UNKNOWN' WHEN interaction % 2 = 0 THEN 'synth' ELSE 'other' END AS b FROM words WHERE interaction % 7 <> 0 AND interaction % 11 <> 0 AND interaction % 13 <> 0),
rg AS (SELECT pr.interaction, pr.turn_index, tw.s - lag(tw.e) OVER (PARTITION BY pr.interaction, pr.turn_index ORDER BY tw.s, tw.turn, tw.seg_idx, tw.word_idx) AS gap, word FROM pr LEFT JOIN tw ON tw.interaction = pr.interaction AND tw.participant = pr.participant AND tw.island = pr.island AND tw.s >= r_s AND tw.e <= r_e),
rr AS (SELECT interaction, turn_index, count(word) AS n FROM rg GROUP BY ALL),
j AS (SELECT p.*, name, a, b, rr.n AS rn, prompt_participant_id = 'P' || 2 * p.interaction AS first, CASE WHEN first THEN a ELSE b END AS pm, CASE WHEN first THEN b ELSE a END AS rm, CASE WHEN first THEN 'speaker1' ELSE 'speaker2' END AS pt, CASE WHEN first THEN 'speaker2' ELSE 'speaker1' END AS rt FROM pairs p JOIN it USING (interaction) JOIN rr USING (interaction, turn_index))
SELECT name || '|' || prompt_participant_id || '|' || response_participant_id || '|' || lpad(turn_index::VARCHAR, greatest(4, length(turn_index::VARCHAR))::INT, '0') AS pair_id, 'probe' AS session_id, name AS interaction_id, dyad_id, turn_index, name || '/' || pt || '_track.wav' AS source_wav_path_prompt, name || '/' || rt || '_track.json' AS source_json_path_response,
prompt_start AS prompt_start_s, prompt_end AS prompt_end_s, response_start AS response_start_s, response_end AS response_end_s, latency AS latency_s, overlap AS overlap_s, prompt_transcript, response_word_count, 'UNKNOWN' AS relationship, pm AS prompt_tts_model, rm AS response_tts_model, pm = 'synth' AS prompt_is_synthetic, rm = 'synth' AS response_is_synthetic, pm <> 'synth' AND rm = 'synth' AS is_human_prompt_synthetic_response, name AS row_dir, pt AS prompt_track, rt AS response_track, 'external' AS split, 'row_dir' AS split_unit,
CASE WHEN rn >= 2 THEN round(60000.0::DOUBLE * rn / (response_end - response_start), 6) END AS response_speech_rate_local FROM j)"""),
    "probe_violations": _w("""SELECT * FROM (WITH it AS (SELECT DISTINCT interaction AS i, CASE WHEN interaction % 13 = 0 THEN 'rows' ELSE 'row' END || '_' || interaction || '_p1_P' || 2 * interaction || '_p2_P' || (2 * interaction + 1) AS name FROM words)
SELECT 'item_files' AS "check", name AS key, CASE WHEN i % 11 = 0 THEN 'metadata.csv,speaker1_track.json,speaker1_track.wav,speaker2_track.json,speaker2_track.wav' ELSE 'speaker2_track.wav' END AS detail FROM it WHERE i % 11 = 0 OR i % 7 = 0
UNION ALL SELECT 'item_name', name, 'unexpected name' FROM it WHERE i % 13 = 0)"""),
    "pcm_files": """WITH e AS (SELECT vec_id // 8 AS i, sum(len(embedding))::BIGINT AS n, sum(list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, round_even(x::DOUBLE * 16384, 0))) / 32768)))  AS total FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1), f AS (SELECT *, i % 10 <> 0 AS fine FROM e)
SELECT i, CASE WHEN fine THEN 8000 END AS sample_rate, CASE WHEN fine THEN 1 END AS channels, CASE WHEN fine THEN n END AS n_frames, CASE WHEN fine THEN (n / 8000.0)::DOUBLE END AS duration_s, CASE WHEN fine THEN 'OK' ELSE 'AUDIO_DECODE_FAILED' END AS status, CASE WHEN fine THEN 52::BIGINT END AS bytes_read, CASE WHEN fine THEN (n + 99) // 100 END AS n_blocks, CASE WHEN fine THEN least(n, 100)::INT END AS longest, CASE WHEN fine THEN round(total, 4) END AS total FROM f""",
    "metadata_files": f"""WITH {_CAND}, ni AS (SELECT 'questions/' || stem || '.wav' AS audio_path, count(*) AS n_inputs FROM base WHERE conv % 3 <> 0 GROUP BY 1)
SELECT translate(model_name, '/|', '--') AS model_name, 'test' AS split, 'all' AS source_style, 'questions/' || stem || '.wav' AS audio_path, answer AS answer_audio_path, md5('P2B: ' || said || ' ') AS digest, conv::VARCHAR AS conversation_id, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN '0.5' ELSE '-0.25' END AS answer_start_time, n_inputs, NULL::VARCHAR AS input_conversation
FROM base LEFT JOIN ni ON ni.audio_path = 'questions/' || stem || '.wav'""",
    "transcripts_file": f"WITH {_CAND} SELECT 'm1' AS model_name, 'test' AS split, 'calm' AS source_style, path AS answer_audio_path, coalesce(txt, '') AS said FROM asr",
    "audio_files": """WITH e AS (SELECT vec_id, vec_id % 10 <> 0 AS fine, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 16384, 0) / 32768)) / 2 AS total FROM embeddings WHERE len(embedding) = 64)
SELECT '/a/' || vec_id || '.wav' AS path, CASE WHEN fine THEN 16000 END AS sample_rate, CASE WHEN fine THEN 32::BIGINT END AS n_frames, CASE WHEN fine THEN 0.002::DOUBLE END AS duration_s, CASE WHEN fine THEN 'OK' ELSE 'AUDIO_DECODE_FAILED' END AS status, CASE WHEN fine THEN round(total, 4) END AS total FROM e""",
    "shards_file": "SELECT (o_orderkey % 16)::INT AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, '5' AS missing FROM orders WHERE o_orderkey % 16 <> 5 GROUP BY 1",
    "pairs_written": f"WITH {_PATHS} SELECT o_orderkey, path FROM p WHERE o_orderkey % 10 = 8",
    "merge_buckets": f"""WITH {_TABLES}, t3 AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS discount FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, lt.part, lt.quantity, price, tax, discount FROM lt JOIN rt USING (l_orderkey, l_linenumber) JOIN t3 USING (l_orderkey, l_linenumber)""",
    "checked_write": """WITH t AS (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN l_quantity - 1 ELSE l_quantity + 1 END AS e FROM lineitem, range(0, 2) AS r(x) WHERE x = 0 OR l_orderkey % 777 = 1), w AS (SELECT count(*) AS n, round(sum(l_quantity)::DOUBLE, 2) AS q FROM t), u AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT unnest(['rows', 'non_empty_key', 'interval', 'shipped', 'unique_key']) AS "check", unnest([n, (SELECT count(*) FROM t WHERE l_orderkey % 1000 = 0), (SELECT count(*) FROM t WHERE e < l_quantity), (SELECT count(*) FROM t WHERE l_shipdate IS NULL), (SELECT coalesce(sum(n), 0)::BIGINT FROM u)]) AS n, n AS written, q AS quantity FROM w""",
    "response_targets": "SELECT o_orderkey AS merge_key, t.name AS target, CASE WHEN o_custkey % (t.i + 5) <> 0 THEN (o_orderkey % (t.i + 7)) / 4.0::DOUBLE END AS value FROM orders, (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(RESPONSE_TARGETS)) + ") AS t(i, name)",
    "encoder_outputs": "SELECT vec_id AS merge_key, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 2, 4) AS e{i}" for i in range(4)) + " FROM embeddings WHERE len(embedding) >= 4",
    "embeddings_committed": "SELECT vec_id AS merge_key, 'prompt' AS role, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE coalesce(len(embedding), -1) END::DOUBLE AS v FROM embeddings",
    "embeddings_written": "SELECT vec_id AS merge_key, 'prompt' AS role, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE round(embedding[1]::DOUBLE, 6) END AS v FROM embeddings",
    "first_rows": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY 1, 2 LIMIT 100",
    "schema_checks": "SELECT * FROM (VALUES ('schema', 'absent', 'missing'), ('schema', 'source', 'unexpected'), ('schema', 'n_chars', 'unexpected')) v(\"check\", key, detail) UNION ALL SELECT 'not_empty', 'documents', 'no rows' WHERE (SELECT count(*) FROM documents) = 0 UNION ALL SELECT 'not_empty', 'none', 'no rows' WHERE (SELECT count(*) FROM documents WHERE doc_id < 0) = 0",
    "embed_outputs": "SELECT vec_id AS merge_key, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / 3)), 4) AS mean_total, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS most_total FROM embeddings WHERE len(embedding) > 0",
    "chunk_predictions": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS power, len(embedding)::INT AS n FROM embeddings WHERE len(embedding) > 0",
    "affect_speech": f"""WITH {_EVENTS}, t AS (SELECT user_id, sum(e - s)::BIGINT AS speech FROM ok WHERE user_id IS NOT NULL GROUP BY 1), c AS (SELECT *, unnest(range(0, greatest(ceil(speech / 900000.0)::BIGINT, 1))) AS i FROM t),
m AS (SELECT user_id, avg((i % 5)::DOUBLE) AS ar, avg((least(i * 900000 + 900000, speech) - i * 900000) / 1000.0::DOUBLE) AS va, count(*) AS n FROM c WHERE least(i * 900000 + 900000, speech) - i * 900000 >= 180000 GROUP BY 1),
u AS (SELECT DISTINCT user_id, (user_id % 6)::DOUBLE AS duration FROM events WHERE user_id IS NOT NULL)
SELECT user_id, duration, CASE WHEN duration >= 3 THEN round(ar, 6) END AS arousal, CASE WHEN duration >= 3 THEN round(va, 6) END AS valence, CASE WHEN duration >= 3 AND speech IS NOT NULL THEN coalesce(n, 0) END AS vox_num_chunks, CASE WHEN duration >= 3 THEN speech END AS vox_support_speech_sec,
CASE WHEN duration < 3 THEN 'TOO_SHORT_FOR_VOX' WHEN coalesce(n, 0) = 0 THEN 'NO_VALID_CHUNKS' ELSE 'OK' END AS status_vox FROM u LEFT JOIN t USING (user_id) LEFT JOIN m USING (user_id)""",
    "clip_profiles": """WITH a AS (SELECT label AS w, vec_id % 3 AS s, avg(embedding[1]::DOUBLE) * 100 AS age FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 GROUP BY ALL)
SELECT o_orderkey, round(p.age, 6) AS prompt_age, round(r.age, 6) AS response_age, CASE WHEN p.w IS NULL THEN 'MISSING_SPEAKER_PROFILE' ELSE 'OK' END AS status_prompt_speaker_profile, CASE WHEN r.w IS NULL THEN 'MISSING_SPEAKER_PROFILE' ELSE 'OK' END AS status_response_speaker_profile
FROM orders LEFT JOIN a p ON p.w = o_custkey % 14 AND p.s = o_orderkey % 4 LEFT JOIN a r ON r.w = o_orderkey % 14 AND r.s = o_custkey % 4""",
    "pitch_states": """WITH f AS (SELECT l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS f0 FROM lineitem),
q AS (SELECT k, count(*) AS n, count(*) FILTER (f0 > 0) AS v, quantile_cont(f0, 0.1) FILTER (f0 > 0) AS lo, quantile_cont(f0, 0.9) FILTER (f0 > 0) AS hi FROM f GROUP BY 1),
s AS (SELECT k, avg(f0) AS m FROM f JOIN q USING (k) WHERE f0 > 0 AND f0 BETWEEN lo AND hi GROUP BY 1),
t AS (SELECT q.k, n, v, m, CASE WHEN k % 4 - 1 < 0 OR k % 7 = 0 OR k % 4 - 1 >= 2 THEN 'SEGMENT_INVALID_FOR_PITCH' WHEN k % 7 < 3 THEN 'SEGMENT_TOO_SHORT_FOR_PITCH' WHEN k % 13 = 0 THEN 'PITCH_ANALYSIS_FAILED' END AS state FROM q LEFT JOIN s USING (k))
SELECT k AS segment_id, CASE WHEN state IS NULL THEN round(m, 6) END AS f0_mean, CASE WHEN state IS NULL THEN round(v / n, 6) END AS voiced_ratio, coalesce(state, CASE WHEN v = 0 THEN 'NO_VOICED_FRAMES' WHEN m IS NULL THEN 'EMPTY_TRIMMED_F0' WHEN v / n < 0.05 THEN 'LOW_VOICED_RATIO' ELSE 'OK' END) AS status_prosody FROM t""",
    "turn_pairs": _w("SELECT * FROM pairs"),
    "turn_pairs_buckets": _w("SELECT * FROM pairs"),
    "turn_pairs_sweep": _w("SELECT * FROM pairs"),
    "turn_events": _w('SELECT interaction, participant, s AS "start", e AS "end", n_events, transcript, n_words::INT AS n_words FROM turns JOIN ttext USING (interaction, participant, island)'),
    "vad_merged": _w('SELECT interaction, participant, s AS "start", e AS "end", n_merged FROM vm'),
    "events_merged": _merged("<="),
    "energy_gap_merge": _merged("<"),
    "speech_total": f"WITH {_EVENTS} SELECT user_id, sum(e - s)::BIGINT AS speech FROM ok GROUP BY 1",
    "backchannel_flags": _w(f"SELECT interaction, participant, turn, seg_idx, string_agg(word, ' ' ORDER BY s, word_idx) AS transcript, lower(string_agg(word, ' ' ORDER BY s, word_idx)) IN ({_LEXICON}) OR (count(*) <= 3 AND count(*) FILTER (lower(word) NOT IN ({_LEXICON})) = 0) AS backchannel FROM words GROUP BY interaction, participant, turn, seg_idx"),
    "neighbour_turns": _w("SELECT interaction, pp AS prompt, participant AS response, pe0 AS prompt_end, s AS response_start, greatest(0, s - pe0) AS latency, greatest(0, pe0 - s) AS overlap FROM line WHERE pp <> participant"),
    "vad_refine": _w('SELECT interaction, participant, s AS "start", e AS "end", rs AS refined_start, re AS refined_end FROM refined'),
    "vad_refine_sweep": _w('SELECT interaction, participant, s AS "start", e AS "end", rs AS refined_start, re AS refined_end FROM refined'),
    "blocked_slices": f"""WITH {_REC}, b AS (SELECT vec_id, path, (off / 64.0 + (vec_id % 3) / 4.0)::DOUBLE AS s, ((vec_id % 7) / 2.0)::DOUBLE AS w FROM re),
c AS (SELECT vec_id, path, round_even(s * 64, 0)::BIGINT AS a, round_even((s + w) * 64, 0)::BIGINT AS b FROM b), st AS (SELECT c.*, CASE WHEN n = 0 THEN 'EMPTY_AUDIO' WHEN b <= a OR b > n THEN 'AUDIO_SEGMENT_INVALID' ELSE 'OK' END AS status FROM c JOIN rn USING (path))
SELECT vec_id AS segment_id, status, CASE WHEN status = 'OK' THEN (b - a)::INT END AS n, (SELECT round(sum(x), 6) FROM rx WHERE rx.path = st.path AND pos >= a AND pos < b AND status = 'OK') AS total FROM st""",
    "blocked_frames": f"WITH {_RECFRAMES} SELECT path, frame_idx, round(center, 6) AS center, round(rms, 6) AS rms FROM x",
    "chunk_contents": f"""WITH {_EVENTS}, c AS (SELECT *, sum(e - s) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS t, sum(e - s) OVER (PARTITION BY user_id)::BIGINT AS everything FROM ok),
k AS (SELECT user_id, s, everything, t - (e - s) AS f, t, unnest(range((t - (e - s)) // 900000, (t - 1) // 900000 + 1)) AS chunk FROM c),
p AS (SELECT user_id, chunk, s + greatest(f, chunk * 900000) - f AS a, s + least(t, (chunk + 1) * 900000) - f AS b FROM k WHERE least(900000, everything - chunk * 900000) >= 180000)
SELECT user_id, chunk::INT AS chunk_idx, (row_number() OVER (PARTITION BY user_id, chunk ORDER BY a, b) - 1)::INT AS piece_idx, a AS "start", b AS "end" FROM p""",
    "voice_from_recordings": f"""WITH {_VOICE} SELECT path, (n / 64.0)::DOUBLE AS duration, CASE WHEN n / 64.0 >= 3 THEN round(arousal, 6) END AS arousal, CASE WHEN n / 64.0 >= 3 THEN round(valence, 6) END AS valence, CASE WHEN n / 64.0 >= 3 THEN round(dominance, 6) END AS dominance,
CASE WHEN n / 64.0 >= 3 THEN CASE WHEN speech IS NULL THEN NULL ELSE coalesce(chunks, 0) END END AS vox_num_chunks, CASE WHEN n / 64.0 >= 3 THEN round(speech, 6) END AS vox_support_speech_sec, CASE WHEN n / 64.0 < 3 THEN 'TOO_SHORT_FOR_VOX' WHEN coalesce(chunks, 0) = 0 THEN 'NO_VALID_CHUNKS' ELSE 'OK' END AS status_vox,
round(up * 100, 6) AS age, CASE WHEN up IS NULL THEN NULL WHEN 1 - up >= up THEN 'female' ELSE 'male' END AS gender, round(greatest(up, 1 - up), 6) AS gender_confidence FROM rn LEFT JOIN cm USING (path) LEFT JOIN ss USING (path)""",
    "vad_refine_buckets": _w('SELECT interaction, participant, s AS "start", e AS "end", rs AS refined_start, re AS refined_end FROM refined'),
    "clip_bounds": _w('SELECT interaction, participant, s AS "start", e AS "end", greatest(s, e - 4000) AS prompt_start, least(e, s + 4000) AS response_end, e - s > 4000 AS was_clipped FROM turns'),
    "tempo_words": _w(
        f"""SELECT * FROM (WITH {_TEMPO} SELECT interaction, participant, s AS "start", CASE WHEN n >= 2 THEN round(60000.0::DOUBLE * n / (e - s), 6) END AS speech_rate_local, CASE WHEN n >= 2 AND e - s - p > 0 THEN round(60000.0::DOUBLE * n / (e - s - p), 6) END AS articulation_rate_local,
CASE WHEN n >= 2 THEN round(p / (e - s), 6) END AS pause_ratio_local, CASE WHEN n >= 2 THEN round(CASE WHEN np > 0 THEN p / np ELSE 0 END, 6) END AS mean_pause_duration_local, CASE WHEN n >= 2 THEN 'OK' ELSE 'TOO_FEW_WORDS_FOR_TEMPORAL' END AS status_temporal FROM turns JOIN a USING (interaction, participant, island))"""
    ),
    "word_gaps": _w("SELECT interaction, turn, count(*) AS n_words, coalesce(sum(gap) FILTER (gap >= 200), 0)::BIGINT AS pause_total, count(*) FILTER (gap >= 200) AS n_pauses FROM (SELECT interaction, turn, s - lag(e) OVER (PARTITION BY interaction, turn ORDER BY s, word_idx) AS gap FROM words) GROUP BY ALL"),
    "pitch_stats": """WITH f AS (SELECT l_suppkey AS segment_id, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS f0 FROM lineitem),
q AS (SELECT segment_id, count(*) AS n, count(*) FILTER (f0 > 0) AS v, quantile_cont(f0, 0.1) FILTER (f0 > 0) AS lo, quantile_cont(f0, 0.9) FILTER (f0 > 0) AS hi FROM f GROUP BY 1),
s AS (SELECT segment_id, avg(f0) AS m, stddev_pop(f0) AS sd FROM f JOIN q USING (segment_id) WHERE f0 > 0 AND f0 BETWEEN lo AND hi GROUP BY 1)
SELECT segment_id, round(m, 6) AS f0_mean, round(sd, 6) AS f0_sd, round(hi - lo, 6) AS f0_range, round(v / n, 6) AS voiced_ratio, CASE WHEN v = 0 THEN 'NO_VOICED_FRAMES' WHEN v / n < 0.05 THEN 'LOW_VOICED_RATIO' ELSE 'OK' END AS status_prosody FROM q LEFT JOIN s USING (segment_id)""",
    "pitch_relative": """WITH f AS (SELECT l_suppkey AS segment_id, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS f0 FROM lineitem),
q AS (SELECT segment_id, quantile_cont(f0, 0.1) FILTER (f0 > 0) AS lo, quantile_cont(f0, 0.9) FILTER (f0 > 0) AS hi FROM f GROUP BY 1),
s AS (SELECT segment_id, avg(f0) AS m, stddev_pop(f0) AS sd FROM f JOIN q USING (segment_id) WHERE f0 > 0 AND f0 BETWEEN lo AND hi GROUP BY 1)
SELECT segment_id, CASE WHEN m > 0 THEN round(sd / m, 6) END AS prompt_f0_sd, CASE WHEN m > 0 THEN round((hi - lo) / m, 6) END AS prompt_f0_range FROM q LEFT JOIN s USING (segment_id)""",
    "frame_rms": f"WITH {_FRAMES} SELECT segment_id, frame_idx, round(center, 6) AS center, round(rms, 6) AS rms FROM x",
    "energy_vad": f'WITH {_SPEECH} SELECT segment_id, round(s, 6) AS "start", round(e, 6) AS "end" FROM sp',
    "tempo_energy": f"""WITH {_SPEECH}, g AS (SELECT *, s - lag(e) OVER (PARTITION BY segment_id ORDER BY s) AS gap FROM sp),
a AS (SELECT segment_id, sum(e - s) AS sec, coalesce(sum(gap) FILTER (gap >= 0.2), 0)::DOUBLE AS p, coalesce(avg(gap) FILTER (gap >= 0.2), 0)::DOUBLE AS mp FROM g GROUP BY 1), o AS (SELECT vec_id AS segment_id, vec_id % 7 AS wc FROM embeddings)
SELECT segment_id, CASE WHEN wc > 0 THEN round(60.0::DOUBLE * wc, 6) END AS speech_rate_local, CASE WHEN wc > 0 AND sec > 0 THEN round(60.0::DOUBLE * wc / sec, 6) END AS articulation_rate_local, round(p, 6) AS pause_ratio_local, round(mp, 6) AS mean_pause_duration_local, round(coalesce(sec, 0), 6) AS vad_speech_sec, round(p, 6) AS vad_pause_sec,
CASE WHEN sec IS NULL THEN 'NO_SPEECH_FRAMES' WHEN wc < 2 THEN 'TOO_FEW_WORDS_FOR_TEMPORAL' ELSE 'OK' END AS status_temporal FROM o LEFT JOIN a USING (segment_id)""",
    "rms_normalized": "WITH e AS (SELECT vec_id AS segment_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding) + 1e-8), 1e-4) AS sc FROM embeddings) SELECT segment_id, unnest(range(0, len(embedding)))::INT AS pos, round(unnest(list_transform(embedding, lambda v: v::DOUBLE / sc)), 6) AS x FROM e",
    "sample_slices": """WITH e AS (SELECT vec_id AS segment_id, embedding, (vec_id % 5 * 8)::INT AS a, (vec_id % 11 * 8)::INT AS b FROM embeddings), s AS (SELECT *, CASE WHEN len(embedding) = 0 OR embedding IS NULL THEN 'EMPTY_AUDIO' WHEN b <= a OR b > len(embedding) THEN 'AUDIO_SEGMENT_INVALID' ELSE 'OK' END AS status FROM e)
SELECT segment_id, status, CASE WHEN status = 'OK' THEN (b - a)::INT END AS n, CASE WHEN status = 'OK' THEN round(list_sum(list_transform(embedding[a + 1:b], lambda v: v::DOUBLE)), 6) END AS total FROM s""",
    "voice_chunks": f"""WITH {_EVENTS}, t AS (SELECT user_id, sum(e - s)::BIGINT AS speech FROM ok GROUP BY 1), c AS (SELECT *, unnest(range(0, greatest(ceil(speech / 900000.0)::BIGINT, 1))) AS chunk_idx FROM t)
SELECT user_id, chunk_idx::INT AS chunk_idx, (chunk_idx * 900000)::INT AS chunk_start, least(chunk_idx * 900000 + 900000, speech) AS chunk_end, speech FROM c WHERE least(chunk_idx * 900000 + 900000, speech) - chunk_idx * 900000 >= 180000""",
    "affect_mean": f"WITH {_THIRDS} SELECT label AS segment_id, round(avg(t0), 6) AS arousal, round(avg(t1), 6) AS valence, round(avg(t2), 6) AS dominance, count(*) AS vox_num_chunks FROM th GROUP BY 1",
    "affect_status": f"""WITH {_THIRDS}, a AS (SELECT label AS segment_id, avg(t0) AS ar, count(*) AS n FROM th GROUP BY 1), s AS (SELECT s_suppkey::INT AS segment_id, (s_suppkey % 6)::DOUBLE AS duration FROM supplier)
SELECT segment_id, duration, CASE WHEN duration >= 3 THEN round(ar, 6) END AS arousal, CASE WHEN duration >= 3 THEN n END AS vox_num_chunks, CASE WHEN duration < 3 THEN 'TOO_SHORT_FOR_VOX' WHEN n IS NULL THEN 'NO_VALID_CHUNKS' ELSE 'OK' END AS status_vox FROM s LEFT JOIN a USING (segment_id)""",
    "speaker_profile": f"WITH {_PROFILES} SELECT label AS wav_key, round(age, 6) AS age, gender, round(best, 6) AS gender_confidence FROM pf",
    "profile_lookup": f"""WITH {_PROFILES}, a AS (SELECT label AS k, gender AS g FROM pf)
SELECT o_orderkey, p.g AS prompt_gender, r.g AS response_gender, CASE WHEN p.k IS NULL THEN 'MISSING_SPEAKER_PROFILE' ELSE 'OK' END AS status_prompt_speaker_profile, CASE WHEN r.k IS NULL THEN 'MISSING_SPEAKER_PROFILE' ELSE 'OK' END AS status_response_speaker_profile FROM orders LEFT JOIN a p ON p.k = o_custkey % 12 LEFT JOIN a r ON r.k = o_orderkey % 12""",
    "profile_keys": "SELECT o_custkey AS wav FROM orders UNION SELECT o_orderkey % 1000 FROM orders",
    "stem_parse": "SELECT o_orderkey, 'V' || o_orderkey % 3 AS vendor, o_custkey::VARCHAR AS session, o_orderkey::VARCHAR AS interaction, o_custkey::VARCHAR AS participant FROM orders",
    "split_from_path": f"WITH {_PATHS}, s AS (SELECT o_orderkey, list_filter(string_split(path, '/'), lambda x: x IN ('train', 'dev', 'test')) AS f FROM p) SELECT o_orderkey, CASE WHEN len(f) = 1 THEN f[1] END AS source_dataset_split, CASE WHEN len(f) = 1 THEN CASE WHEN f[1] = 'test' THEN 'test' ELSE 'train' END END AS split FROM s",
    "dyad_ids": "WITH i AS (SELECT o_orderkey, 'P' || o_custkey AS a, 'P' || o_orderkey % 1000 AS b FROM orders) SELECT o_orderkey, least(a, b) || '|' || greatest(a, b) AS dyad_id, o_orderkey || '|' || a || '|' || b || '|' || printf('%04d', o_orderkey % 20000) AS pair_id FROM i",
    "row_dir_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey::VARCHAR END AS row_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'P' || o_custkey END AS p1, CASE WHEN o_orderkey % 9 <> 0 THEN 'P' || o_orderkey % 77 END AS p2 FROM orders",
    "rel_normalize": f"WITH {_REL} SELECT place, nd AS detail FROM nrel",
    "rel_join": f"""WITH {_REL}, one AS (SELECT session_id, arg_max(relationship, place) AS relationship, arg_max(nd, place) AS nd FROM nrel GROUP BY 1)
SELECT s_suppkey, 'V' AS vendor_id, (s_suppkey % 30)::INT AS session_id, coalesce(relationship, 'UNKNOWN') AS relationship, coalesce(nd, 'UNKNOWN') AS relationship_detail, CASE WHEN relationship IS NULL THEN 'MISSING_RELATIONSHIP_METADATA' ELSE 'OK' END AS status_relationship FROM supplier LEFT JOIN one ON one.session_id = s_suppkey % 30""",
    "dyad_recordings": "SELECT a.o_orderkey, a.o_custkey AS p1_cust, b.o_custkey AS p2_cust FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0",
    "merge_final": f"WITH {_TABLES} SELECT l_orderkey, l_linenumber, lt.part, round(lt.quantity / 3, 6) AS quantity, price, tax, l_orderkey || '|' || l_linenumber || '|' || lt.part AS merge_key FROM lt JOIN rt USING (l_orderkey, l_linenumber)",
    "merge_key_text": f"SELECT c_custkey, c_custkey || '|' || {_NUMBER.format('round(c_acctbal / 7, 6)')} AS merge_key FROM customer",
    "merge_anti": f"WITH {_TABLES} SELECT l_orderkey, l_linenumber, 'left' AS side FROM lt ANTI JOIN rt USING (l_orderkey, l_linenumber) UNION ALL SELECT l_orderkey, l_linenumber, 'right' FROM rt ANTI JOIN lt USING (l_orderkey, l_linenumber)",
    "merge_semi": f"WITH {_TABLES} SELECT l_orderkey, l_linenumber FROM lt SEMI JOIN rt USING (l_orderkey, l_linenumber)",
    "dup_report": "SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows, count(*) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "shared_mismatch": _MISMATCH + " SELECT 'part' AS \"column\", a AS mismatches, compared FROM m UNION ALL SELECT 'quantity', b, compared FROM m",
    "quality_violations": _MISMATCH
    + f""", {_EVENTS}, bad AS (SELECT user_id, s FROM ok WHERE user_id % 50 = 0)
SELECT 'unique_key' AS "check", l_orderkey || '|' || l_linenumber AS key, count(*) || ' rows' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'interval', user_id || '|' || s, 'inverted' FROM bad UNION ALL SELECT 'non_empty_key', 'k', 'empty' FROM lineitem WHERE l_orderkey % 1000 = 0
UNION ALL SELECT 'shared_columns', 'part', a || ' of ' || compared FROM m WHERE a > 0 UNION ALL SELECT 'shared_columns', 'quantity', b || ' of ' || compared FROM m WHERE b > 0""",
    "dyad_checks": f"""WITH {_PATHS}, q AS (SELECT o_orderkey AS k, 'V' || o_orderkey % 3 AS vendor, o_custkey AS session, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' WHEN o_orderkey % 10 < 9 THEN 'test' END AS sp FROM p),
b AS (SELECT a.k, concat_ws(',', CASE WHEN a.vendor <> b.vendor THEN 'vendor' END, CASE WHEN a.session <> b.session THEN 'session' END, CASE WHEN a.k <> b.k THEN 'interaction' END, CASE WHEN a.sp IS DISTINCT FROM b.sp THEN 'source_split' END, CASE WHEN a.k % 17 = 0 THEN 'participant1' END, CASE WHEN b.k % 17 = 0 THEN 'participant2' END) AS bad FROM q a JOIN q b ON b.k - 3 = a.k) SELECT 'dyad_consistent' AS "check", k::VARCHAR AS key, bad AS detail FROM b WHERE bad <> ''""",
    "shard_audit": """WITH i AS (SELECT DISTINCT (o_orderkey % 16)::INT AS i FROM orders WHERE o_orderkey % 16 <> 5), s AS (SELECT i AS x FROM i WHERE i <> 9 UNION ALL SELECT 3 FROM i WHERE i = 3 UNION ALL SELECT 31 FROM i WHERE i = 9 UNION ALL SELECT NULL FROM i WHERE i = 9)
SELECT 'shard' AS "check", '' AS key, 'unindexed' AS detail FROM s WHERE x IS NULL UNION ALL SELECT 'shard', x::VARCHAR, 'duplicate' FROM s WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1
UNION ALL SELECT 'shard', r::VARCHAR, 'missing' FROM range(16) g(r) WHERE r NOT IN (SELECT x FROM s WHERE x IS NOT NULL) UNION ALL SELECT DISTINCT 'shard', x::VARCHAR, 'extra' FROM s WHERE x >= 16""",
    "candidate_manifest": f"""WITH {_CAND}, n AS (SELECT *, {_CANDID} AS id, greatest(pd - 15, 0)::DOUBLE AS p0, pd AS p1, 0::DOUBLE AS r0, least(rd, 15)::DOUBLE AS r1 FROM m WHERE status = 'OK')
SELECT id AS pair_id, id AS candidate_id, 'candidates' AS session_id, conv::VARCHAR AS interaction_id, speakers AS dyad_id,
CASE WHEN {_LASTP.format('q')} <> '' THEN {_LASTP.format('q')} ELSE coalesce(sp[1], '') END AS prompt_participant_id, CASE WHEN model_name <> 'original' THEN model_name WHEN {_FIRSTP.format('meta')} <> '' THEN {_FIRSTP.format('meta')} ELSE coalesce(sp[2], '') END AS response_participant_id, conv::BIGINT AS turn_index,
model_name, model_name = 'original' AS is_original_reference, split, source_style, 'candidates' AS source_dataset_split, '' AS split_seed, 'candidate_question' AS split_unit, conv::VARCHAR AS conversation_id, speakers, stem AS prompt_stem, k::VARCHAR AS response_stem, 'stop' AS finish_reason, st AS answer_start_time, greatest(st, 0) AS latency_s, greatest(-st, 0) AS overlap_s,
ppath AS prompt_audio_path, rpath AS response_audio_path, ppath AS source_wav_path_prompt, rpath AS source_wav_path_response, '' AS source_json_path_prompt, '' AS source_json_path_response,
p0 AS prompt_start_s, p1 AS prompt_end_s, p1 - p0 AS prompt_duration_s, r0 AS response_start_s, r1 AS response_end_s, r1 - r0 AS response_duration_s, pd AS prompt_audio_duration_s, rd AS response_audio_duration_s, p0 AS prompt_clip_start_s, p1 AS prompt_clip_end_s, r0 AS response_clip_start_s, r1 AS response_clip_end_s,
pd > 15 AS prompt_was_clipped, rd > 15 AS response_was_clipped, pd >= 3 AS prompt_vox_compatible, rd >= 3 AS response_vox_compatible, q AS prompt_transcript, resp AS response_transcript, meta AS response_metadata_transcript, asr_text AS response_asr_transcript, {_WORDCOUNT.format('q')} AS prompt_word_count, {_WORDCOUNT.format('resp')} AS response_word_count,
'UNKNOWN' AS relationship, 'UNKNOWN' AS relationship_detail, 'MISSING_RELATIONSHIP_METADATA' AS status_relationship, 'OK' AS status_pair, 'OK' AS status_prompt_audio, 'OK' AS status_response_audio, CASE WHEN hit THEN 'INPUT_METADATA' ELSE 'OUTPUT_METADATA_FALLBACK' END AS status_prompt_source, 'OUTPUT_METADATA' AS status_response_source FROM n""",
    "candidate_skips": f"WITH {_CAND} SELECT {_CANDID.replace('|| k', "|| CASE WHEN answer = '' THEN '' ELSE k::VARCHAR END")} AS pair_id, concat_ws('/', 'outputs', model_name, split, source_style, 'metadata.csv') AS metadata_csv, 'questions/' || stem || '.wav' AS audio_path, answer AS answer_audio_path, model_name, split, source_style, stem AS prompt_stem, ppath AS prompt_audio_path, rpath AS response_audio_path, status AS status_pair FROM m WHERE status <> 'OK'",
    "candidate_counts": f"WITH {_CAND} SELECT model_name, split, source_style, count(*) FILTER (status = 'OK') AS usable, count(*) FILTER (status <> 'OK') AS skipped FROM m GROUP BY ALL",
    "asr_fallback": f"WITH {_CAND} SELECT model_name, source_style, count(*) FILTER (asr_text <> '') AS heard, count(*) AS n FROM m GROUP BY ALL",
    "speaker_tags": f"WITH x AS (SELECT doc_id, 'P1A: ' || coalesce(text, '') || ' P' || doc_id || ': end' AS t FROM documents) SELECT doc_id, {_FIRSTP.format('t')} AS first, {_LASTP.format('t')} AS last, 'P' || doc_id AS fallback FROM x",
    "word_counts": f"SELECT doc_id, {_WORDCOUNT.format('text')} AS words FROM documents",
    "normalized_text": r"SELECT conv_id, turn, md5(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS digest FROM conversations",
    "probe_tts_majority": """WITH v AS (SELECT user_id % 3 AS row_dir, user_id::VARCHAR AS spk, CASE WHEN event_id % 4 = 0 THEN 'orig' ELSE event_type END AS tts_model, count(*) AS n, min(event_id) AS f FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT row_dir, spk, arg_max(tts_model, (n, -f)) AS tts_model, max(n) AS votes FROM v GROUP BY ALL""",
    "probe_complete": "WITH k AS (SELECT unnest(['click', 'logout', 'purchase', 'signup', 'view']) AS k), u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, k FROM u, k ANTI JOIN events e ON e.user_id = u.user_id AND e.event_type = k) SELECT u.user_id AS row_dir, coalesce(string_agg(k, ',' ORDER BY k), '') AS missing, count(k) = 0 AS complete FROM u LEFT JOIN m USING (user_id) GROUP BY 1",
    "probe_flags": """WITH j AS (SELECT o_orderkey, coalesce(p.c_mktsegment, 'UNKNOWN') AS p, coalesce(r.c_mktsegment, 'UNKNOWN') AS r FROM orders LEFT JOIN customer p ON p.c_custkey = o_custkey AND p.c_custkey % 5 <> 0 LEFT JOIN customer r ON r.c_custkey = o_orderkey % 100 AND r.c_custkey % 5 <> 0)
SELECT o_orderkey, p AS prompt_tts_model, r AS response_tts_model, p = 'BUILDING' AS prompt_is_synthetic, r = 'BUILDING' AS response_is_synthetic, p <> 'BUILDING' AND r = 'BUILDING' AS is_human_prompt_synthetic_response FROM j""",
    "embed_pool": "WITH u AS (SELECT label, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL) SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean, round(max(x)::DOUBLE, 6) AS most FROM u GROUP BY ALL",
    "embed_atomic": f"WITH {_ROLES} SELECT merge_key, role, status FROM ra",
    "embed_segments": f"WITH {_ROLES} SELECT merge_key, role, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 3) AS total, round(list_max(embedding)::DOUBLE, 3) AS most, round(list_min(embedding)::DOUBLE, 3) AS least FROM ra WHERE status = 'OK'",
    "embed_manifest": f"""WITH {_ROLES}, k AS (SELECT DISTINCT merge_key FROM rv), p AS (SELECT * FROM ra WHERE role = 'prompt'), r AS (SELECT * FROM ra WHERE role = 'response')
SELECT merge_key, CASE WHEN p.role IS NOT NULL THEN 'vec/prompt/' || merge_key END AS prompt_vec_path, len(p.embedding)::INT AS prompt_vec_shape, p.status AS prompt_status, CASE WHEN r.role IS NOT NULL THEN 'vec/response/' || merge_key END AS response_vec_path, len(r.embedding)::INT AS response_vec_shape, r.status AS response_status, 'm1' AS model FROM k LEFT JOIN p USING (merge_key) LEFT JOIN r USING (merge_key)""",
    "embed_align": f"WITH {_ROLES} SELECT p.merge_key, round(list_sum(list_transform(p.embedding, lambda v: v::DOUBLE)), 6) AS prompt_sum, round(list_sum(list_transform(r.embedding, lambda v: v::DOUBLE)), 6) AS response_sum FROM rv p JOIN rv r ON p.merge_key = r.merge_key AND p.role = 'prompt' AND r.role = 'response' AND p.status0 = 'OK' AND r.status0 = 'OK'",
    "embed_status": "SELECT CASE WHEN vec_id % 9 = 0 OR embedding IS NULL THEN 'AUDIO_LOAD_FAILED' WHEN vec_id % 8 = 0 THEN 'AUDIO_DECODE_FAILED' WHEN len(embedding) = 0 THEN 'EMPTY_AUDIO' WHEN vec_id % 11 <= vec_id % 5 OR vec_id % 11 * 8 > len(embedding) THEN 'AUDIO_SEGMENT_INVALID' ELSE 'OK' END AS status, count(*) AS count FROM embeddings GROUP BY 1",
    "artifact_names": "SELECT o_orderkey, 'a__b_' || o_orderkey || '_x__' || substr(sha1(o_custkey::VARCHAR), 1, 12) || '__prompt' AS name FROM orders",
    "history_window": """WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), h AS (SELECT conv_id, turn, list(coalesce(n::VARCHAR, '-')) OVER w AS l, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT conv_id AS interaction_id, turn AS turn_index, array_to_string(list_concat(list_resize([]::VARCHAR[], (3 - k)::BIGINT, '-'), coalesce(l, [])), ',') AS history, array_to_string(list_concat(list_resize([]::VARCHAR[], (3 - k)::BIGINT, '0'), list_resize([]::VARCHAR[], k::BIGINT, '1')), ',') AS mask FROM h""",
    "zscore": "WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_partkey % 10 < 6) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / s, 4) AS q, 0.0::DOUBLE AS same FROM lineitem, f",
    "mse_r2": f"WITH {_PRED}, s AS (SELECT condition, target, count(*) AS n, {_SCORES} FROM pd GROUP BY ALL) SELECT condition, target, n, round(mse, 6) AS mse, round(r2, 6) AS r2 FROM s",
    "mse_r2_mean": f"WITH {_PRED}, s AS (SELECT condition, target, {_SCORES} FROM pd GROUP BY ALL) SELECT condition, round(avg(mse), 6) AS mse, round(avg(r2), 6) AS r2 FROM s GROUP BY ALL",
    "c_index": f"""WITH {_PRED}, u AS (SELECT condition, target, y, mu, count(*) AS n FROM pd GROUP BY ALL), c AS (SELECT a.condition, a.target, sum(a.n * b.n) AS comparable, sum(a.n * b.n * CASE WHEN a.mu > b.mu THEN 1.0 WHEN a.mu = b.mu THEN 0.5 ELSE 0 END) AS good FROM u a JOIN u b ON a.condition = b.condition AND a.target = b.target AND a.y > b.y GROUP BY ALL)
SELECT condition, target, comparable::BIGINT AS comparable, round(good::DOUBLE / comparable::DOUBLE, 6) AS c_index FROM c""",
    "delta_ll": f"WITH {_PRED}, s AS (SELECT condition, target, {_DLL} FROM ll GROUP BY ALL) SELECT condition, target, round(a, 6) AS natural_ll, round(b, 6) AS probe_ll, round(a - b, 6) AS delta_ll FROM s",
    "balanced_score": f"WITH {_PRED}, s AS (SELECT condition || target AS condition, round({_SCORES.split(' AS mse')[0]}, 6) AS mse, round(avg(ll) FILTER (dataset = 'natural_test') - avg(ll) FILTER (dataset = 'probe'), 6) AS delta_ll FROM ll GROUP BY 1) SELECT *, round((percent_rank() OVER (ORDER BY mse DESC) + percent_rank() OVER (ORDER BY delta_ll ASC NULLS FIRST)) / 2, 6) AS balanced FROM s",
    "sweep_winners": f"WITH {_PRED}, s AS (SELECT condition, target, round({_SCORES.split(' AS mse')[0]}, 6) AS mse, round(avg(ll) FILTER (dataset = 'natural_test') - avg(ll) FILTER (dataset = 'probe'), 6) AS d FROM ll GROUP BY ALL) SELECT target, arg_min(condition, (mse, condition)) AS least_error, arg_min(condition, (-d, condition)) AS largest_gain FROM s WHERE d IS NOT NULL GROUP BY 1",
    "ratings_summary": f"WITH {_CLIPS}, g AS (SELECT condition, overall, style FROM cl UNION ALL SELECT 'pooled', overall, style FROM cl WHERE condition IN ('click', 'view')) SELECT condition, count(*) AS n, round(avg(overall), 6) AS overall_mean, round(stddev_samp(overall), 6) AS overall_sd, round(avg(style), 6) AS style_avg_mean, round(stddev_samp(style), 6) AS style_avg_sd FROM g GROUP BY 1",
    "mann_whitney": f"""WITH {_CLIPS}, v AS (SELECT round(overall, 6) AS x, condition = 'click' AS a FROM cl WHERE condition IN ('click', 'view')), r AS (SELECT a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM v GROUP BY x)), s AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(r) FILTER (a) AS ra FROM r),
u AS (SELECT n_a, n_b, ra - n_a * (n_a + 1) / 2 AS u, sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS sd FROM s, t), z AS (SELECT n_a, n_b, u, (u - n_a * n_b / 2) / sd AS z FROM u),
p AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS k FROM z)
SELECT n_a, n_b, u::DOUBLE AS u, round(z, 6) AS z, round(2 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) * exp(-z * z / 2) / sqrt(2 * pi()), 6) AS p FROM p""",
    "response_unpivot": _w(
        """SELECT * FROM (WITH rwd AS (SELECT pr.interaction, pr.turn_index, r_e - r_s AS dur, tw.s - lag(tw.e) OVER (PARTITION BY pr.interaction, pr.turn_index ORDER BY tw.s, tw.turn, tw.seg_idx, tw.word_idx) AS gap, word FROM pr LEFT JOIN tw ON tw.interaction = pr.interaction AND tw.participant = pr.participant AND tw.island = pr.island AND tw.s >= r_s AND tw.e <= r_e),
a AS (SELECT interaction, turn_index, any_value(dur) AS dur, count(word) AS n, coalesce(sum(gap) FILTER (gap >= 200), 0)::DOUBLE AS p FROM rwd GROUP BY ALL), k AS (SELECT pairs.pair_id AS merge_key, a.* FROM a JOIN pairs USING (interaction, turn_index))
SELECT merge_key, 'duration_s' AS target, round(dur::DOUBLE, 6) AS value FROM k UNION ALL SELECT merge_key, 'word_count', n::DOUBLE FROM k UNION ALL SELECT merge_key, 'speech_rate_local', CASE WHEN n >= 2 THEN round(60000.0::DOUBLE * n / dur, 6) END FROM k UNION ALL SELECT merge_key, 'pause_ratio_local', CASE WHEN n >= 2 THEN round(p / dur, 6) END FROM k)"""
    ),
    "speaker_components": """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 31 + o_orderkey % 3) % 20000 AS b FROM orders), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM d GROUP BY a UNION SELECT d.b, min(r.m) FROM r JOIN d ON d.a = r.n JOIN recurring.r AS k ON k.n = d.b WHERE r.m < k.m GROUP BY d.b) SELECT n AS speaker, m AS component FROM r""",
    "component_split": """WITH RECURSIVE e AS (SELECT o_custkey AS a, (o_custkey * 31 + o_orderkey % 3) % 20000 AS b FROM orders), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) USING KEY (n) AS (SELECT a, min(least(a, b)) FROM d GROUP BY a UNION SELECT d.b, min(r.m) FROM r JOIN d ON d.a = r.n JOIN recurring.r AS k ON k.n = d.b WHERE r.m < k.m GROUP BY d.b), k AS (SELECT n, m AS component FROM r),
w AS (SELECT component, count(*) AS weight FROM e JOIN k ON k.n = e.a GROUP BY 1), z AS (SELECT component, count(*) AS n_speakers FROM k GROUP BY 1),
o AS (SELECT w.*, row_number() OVER (ORDER BY weight DESC, md5('0:' || component)) AS rn, sum(weight) OVER ()::DOUBLE AS total FROM w),
g(rn, a, b, c, pick) AS (SELECT 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, '' UNION ALL
  SELECT rn, a + CASE WHEN p = 'train' THEN weight ELSE 0 END, b + CASE WHEN p = 'val' THEN weight ELSE 0 END, c + CASE WHEN p = 'test' THEN weight ELSE 0 END, p
  FROM (SELECT o.rn, o.weight, g.a, g.b, g.c, CASE WHEN abs(g.a + weight - 0.6::DOUBLE * total) <= least(abs(g.b + weight - 0.1::DOUBLE * total), abs(g.c + weight - 0.3::DOUBLE * total)) THEN 'train' WHEN abs(g.b + weight - 0.1::DOUBLE * total) <= abs(g.c + weight - 0.3::DOUBLE * total) THEN 'val' ELSE 'test' END AS p FROM g JOIN o ON o.rn = g.rn + 1))
SELECT component, weight, n_speakers, pick AS split FROM o JOIN g USING (rn) JOIN z USING (component)""",
}
