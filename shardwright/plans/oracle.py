"""DuckDB twins of the registered queries (same tables, same column names).

Written independently of the Spark code: token streams are rebuilt from the
text's code points, geometry uses closed forms where one exists, and global
orders use plain ``row_number()``/``sum() OVER (ORDER BY …)``.
"""

from __future__ import annotations

from shardwright.config import windows_in
from shardwright.functions.encoders import WORD_PATTERN
from shardwright.operators.permutation import ROUNDS
from shardwright.plans import registry as R

NW = windows_in(R.S, R.T, R.STRIDE)
NW64 = windows_in(R.S, R.T, R.ONE_STRIDE)

# UTF-8 bytes of each code point, then EOS (256)
BYTES = ("(CASE WHEN text = '' THEN []::INTEGER[] ELSE flatten(list_transform(string_split(text, ''), "
         "lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] "
         "WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] "
         "WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] "
         "ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), "
         "128 + (unicode(c) & 63)] END)) END || [256])")
NTOK = "(octet_length(encode(text)) + 1)"
TOTAL = f"(SELECT sum({NTOK})::BIGINT FROM documents)"
TOTAL_EXPR = TOTAL
# one shard holding the whole stream: windows, train cut, first dev window
NW1 = f"greatest(0, ({TOTAL_EXPR} - {R.T + 1}) // {R.ONE_STRIDE} + 1)"
SPLIT1 = f"floor(0.95 * {NW1})::BIGINT"
DEV1 = f"least({NW1}, {SPLIT1} + {(R.T + R.ONE_STRIDE - 1) // R.ONE_STRIDE})"

NCOMM = f"({TOTAL} // {R.S})"
CAP = f"greatest(1, {TOTAL} // {R.S} // 2)"
CUT = f"least({NCOMM} - 1, greatest(1, round_even(0.95 * {NCOMM}, 0)::BIGINT))"

SQL: dict[str, str] = {}

SQL["doc_token_counts"] = f"""
WITH b AS (SELECT doc_id, {BYTES} AS ids FROM documents)
SELECT doc_id, len(ids)::BIGINT AS n_tokens, list_sum(ids)::BIGINT AS id_sum, ids[1]::BIGINT AS first_id FROM b
"""

SQL["token_offsets"] = f"""
SELECT doc_id, {NTOK}::BIGINT AS n_tokens,
       (sum({NTOK}) OVER (ORDER BY doc_id) - {NTOK})::BIGINT AS start,
       (sum({NTOK}) OVER (ORDER BY doc_id))::BIGINT AS "end"
FROM documents
"""

_OFFS = (f"offs AS (SELECT doc_id, {NTOK}::BIGINT AS n, (sum({NTOK}) OVER (ORDER BY doc_id) - {NTOK})::BIGINT AS start "
         "FROM documents)")

SQL["shard_segments"] = f"""
WITH {_OFFS},
segs AS (SELECT doc_id, s AS shard, greatest(start, s * {R.S}) AS lo, least(start + n, (s + 1) * {R.S}) AS hi
         FROM offs, unnest(generate_series(start // {R.S}, (start + n - 1) // {R.S})) AS g(s))
SELECT shard::BIGINT AS shard, count(*)::BIGINT AS segments, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       sum(hi - lo)::BIGINT AS tokens,
       (shard < least({CAP}, {TOTAL} // {R.S}))::INTEGER AS committed
FROM segs GROUP BY shard
"""

SQL["build_totals"] = f"""
WITH {_OFFS},
p AS (SELECT t::BIGINT AS t, least({CAP}, t // {R.S}) AS nc, least({CAP}, t // {R.S}) * {R.S} AS cut,
             ({CAP} * {R.S} < t) AS capped FROM (SELECT sum(n) AS t FROM offs))
SELECT sum(CASE WHEN NOT p.capped OR start < p.cut THEN 1 ELSE 0 END)::BIGINT AS documents_used,
       max(p.nc)::BIGINT AS shards_committed, max(p.cut)::BIGINT AS committed_tokens,
       sum(CASE WHEN NOT p.capped OR start < p.cut THEN greatest(start + n - greatest(start, p.cut), 0) ELSE 0 END)::BIGINT
         AS pending_tokens,
       max(p.t)::BIGINT AS stream_tokens
FROM offs, p
"""

SQL["pack_windows"] = f"""
WITH b AS (SELECT doc_id, {BYTES} AS ids FROM documents),
offs AS (SELECT ids, (sum(len(ids)) OVER (ORDER BY doc_id) - len(ids))::BIGINT AS start FROM b),
toks AS (SELECT start + i AS g, tok FROM (SELECT start, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM offs)),
pos AS (SELECT g // {R.S} AS shard, g % {R.S} AS p, tok FROM toks WHERE g < {NCOMM} * {R.S}),
win AS (SELECT shard, k, p, tok FROM pos,
        unnest(generate_series(greatest(0, ceil((p - {R.T}) / {R.STRIDE}))::BIGINT, least({NW - 1}, p // {R.STRIDE}))) AS g(k))
SELECT (shard * {NW} + k)::BIGINT AS seq_index, shard::BIGINT AS shard, k::BIGINT AS k, count(*)::BIGINT AS n_tokens,
       arg_min(tok, p)::BIGINT AS first_token, arg_max(tok, p)::BIGINT AS last_token, sum(tok)::BIGINT AS token_sum,
       md5(string_agg(tok::VARCHAR, ',' ORDER BY p)) AS window_md5
FROM win GROUP BY shard, k
"""

SQL["window_lookup"] = f"""
WITH p AS (SELECT {NCOMM} * {NW} AS n),
q AS (SELECT doc_id, doc_id * {R.LOOKUP_MUL} - {R.LOOKUP_OFF} AS idx, n FROM documents, p),
r AS (SELECT doc_id, idx, n, CASE WHEN idx < 0 THEN idx + n ELSE idx END AS gi FROM q)
SELECT doc_id, idx,
       (CASE WHEN gi >= 0 AND gi < n THEN gi // {NW} END)::BIGINT AS shard,
       (CASE WHEN gi >= 0 AND gi < n THEN gi % {NW} END)::BIGINT AS k,
       (CASE WHEN gi >= 0 AND gi < n THEN 0 ELSE 1 END)::INTEGER AS out_of_range
FROM r
"""

SQL["split_plan"] = f"""
WITH sh AS (SELECT unnest(generate_series(0, {NCOMM} - 1)) AS shard)
SELECT shard::BIGINT AS shard, {R.S}::BIGINT AS n_tokens, {NW}::BIGINT AS n_seqs,
       (shard * {NW})::BIGINT AS seq_start, ((shard + 1) * {NW})::BIGINT AS seq_end,
       CASE WHEN shard < {CUT} THEN 'train' ELSE 'dev' END AS split
FROM sh
"""

SQL["single_shard_split"] = f"""
WITH w AS (SELECT unnest(generate_series(0, {NW1} - 1)) AS seq_index)
SELECT seq_index::BIGINT AS seq_index, CASE WHEN seq_index < {SPLIT1} THEN 'train' ELSE 'dev' END AS split,
       (CASE WHEN seq_index < {SPLIT1} THEN seq_index ELSE seq_index - {DEV1} END)::BIGINT AS local_index
FROM w WHERE seq_index < {SPLIT1} OR seq_index >= {DEV1}
"""

_PER = f"(({CUT} * {NW}) // {R.B})"
_ACCUM = f"(CASE WHEN {_PER} % 4 = 0 THEN 4 WHEN {_PER} % 2 = 0 THEN 2 ELSE 1 END)"
_TRAIN = f"tr AS (SELECT unnest(generate_series(0, {CUT} * {NW} - 1)) AS local_index)"
_KEY = "md5(CAST({seed} + epoch AS VARCHAR) || ':' || CAST(local_index AS VARCHAR))"

SQL["hashed_order"] = f"""
WITH {_TRAIN}, e AS (SELECT unnest([0, 1]) AS epoch)
SELECT epoch::BIGINT AS epoch, local_index::BIGINT AS local_index,
       (row_number() OVER (PARTITION BY epoch ORDER BY {_KEY.format(seed=R.SEED)}, local_index) - 1)::BIGINT AS position
FROM tr, e
"""

SQL["hashed_batches"] = f"""
WITH {_TRAIN}, e AS (SELECT 0 AS epoch),
o AS (SELECT local_index, row_number() OVER (ORDER BY {_KEY.format(seed=R.SEED)}, local_index) - 1 AS position
      FROM tr, e)
SELECT local_index::BIGINT AS local_index, position::BIGINT AS position, (position // {R.B})::BIGINT AS batch,
       (position // {R.B} // {_ACCUM})::BIGINT AS step, ((position // {R.B}) % {R.WORLD})::BIGINT AS rank
FROM o WHERE position < ((SELECT count(*) FROM tr) // {R.B}) * {R.B}
"""


# six Feistel rounds over a packed number, again while it is outside the range
_T1 = "((a & m) * 73244475 + k) % 4294967296"
_T2 = f"(xor({_T1}, ({_T1}) >> 16) * 73244475) % 4294967296"
_FEISTEL = f"list_reduce(list_prepend({{0}}, ks), lambda a, k: ((a & m) << h) | xor(a >> h, xor({_T2}, ({_T2}) >> 15) & m))"


def _walked(places: str) -> str:
    """``w (epoch, position, x)``: the index at each ``(epoch, position)`` of ``places``, walks included."""
    return f"""WITH RECURSIVE {_TRAIN}, nn AS (SELECT count(*)::BIGINT AS n FROM tr),
hh AS (SELECT n, greatest(1, (length(bin(n - 1)) + 1) // 2) AS h FROM nn),
mm AS (SELECT n, h, (1::BIGINT << h) - 1 AS m FROM hh),
pl AS ({places}),
kk AS (SELECT epoch, [('0x' || substr(md5(({R.SEED} + epoch) || ':' || r), 1, 8))::BIGINT FOR r IN range({ROUNDS})] AS ks FROM (SELECT DISTINCT epoch FROM pl)),
w(epoch, position, x) AS (
  SELECT pl.epoch, position, {_FEISTEL.format('position')} FROM pl JOIN kk USING (epoch), mm
  UNION ALL SELECT w.epoch, position, {_FEISTEL.format('x')} FROM w JOIN kk USING (epoch), mm WHERE x >= n)"""


SQL["epoch_order"] = f"""
{_walked("SELECT epoch::BIGINT AS epoch, position::BIGINT AS position FROM nn, unnest([0, 1]) AS e(epoch), unnest(generate_series(0, n - 1)) AS g(position)")}
SELECT epoch, x AS local_index, position FROM w, nn WHERE x < n
"""

SQL["batches"] = f"""
{_walked(f"SELECT 0::BIGINT AS epoch, position::BIGINT AS position FROM nn, unnest(generate_series(0, n // {R.B} * {R.B} - 1)) AS g(position)")}
SELECT x AS local_index, position, position // {R.B} AS batch, (position // {R.B} // {_ACCUM})::BIGINT AS step,
       ((position // {R.B}) % {R.WORLD})::BIGINT AS rank FROM w, nn WHERE x < n
"""

SQL["remaining_plan"] = f"""
{_walked(f"""SELECT (q // ({_PER} * {R.B}))::BIGINT AS epoch, (q % ({_PER} * {R.B}))::BIGINT AS position
FROM unnest(generate_series({R.RESUME_STEP} * {_ACCUM} * {R.B}, {R.MAX_STEPS} * {_ACCUM} * {R.B} - 1)) AS g(q)""")}
SELECT epoch, position // {R.B} AS batch, (epoch * ({_PER} // {_ACCUM}) + position // {R.B} // {_ACCUM})::BIGINT AS step,
       x AS local_index, position FROM w, nn WHERE x < n
"""

SQL["coverage"] = f"""
WITH sh AS (SELECT unnest(generate_series(0, {NCOMM} - 1)) AS shard)
SELECT shard::BIGINT AS shard, {NW64}::BIGINT AS windows, ({NW64} * {R.T + 1})::BIGINT AS nominal_tokens,
       ({(NW64 - 1) * R.ONE_STRIDE + R.T + 1})::BIGINT AS unique_tokens,
       round(1.0 - {(NW64 - 1) * R.ONE_STRIDE + R.T + 1} / {NW64 * (R.T + 1)}, 6) AS overlap_share
FROM sh
"""

SQL["leakage"] = f"""
WITH g AS (SELECT {NW1} AS nw, {SPLIT1} AS sp, {DEV1} AS dv),
t AS (SELECT nw, sp, dv, (sp - 1) * {R.ONE_STRIDE} + {R.T + 1} AS tr_tok,
             (nw - 1 - dv) * {R.ONE_STRIDE} + {R.T + 1} AS dv_tok,
             greatest(0, (sp - 1) * {R.ONE_STRIDE} + {R.T + 1} - dv * {R.ONE_STRIDE}) AS over FROM g)
SELECT 0::BIGINT AS shard, (tr_tok + dv_tok - over)::BIGINT AS all_tokens, tr_tok::BIGINT AS train_tokens,
       dv_tok::BIGINT AS dev_tokens, over::BIGINT AS leaked_tokens
FROM t WHERE sp > 0 AND dv < nw
"""

_WORDS = f"regexp_extract_all(text, '{WORD_PATTERN}')"
_VOCAB = f"""c AS (SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word),
v AS (SELECT word, (row_number() OVER (ORDER BY count DESC, word) + 1)::BIGINT AS id, count FROM c
      QUALIFY row_number() OVER (ORDER BY count DESC, word) <= {R.VOCAB - 2})"""

SQL["word_vocab"] = f"""
WITH {_VOCAB}
SELECT word, id, count FROM v
"""

SQL["word_encode"] = f"""
WITH {_VOCAB},
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word FROM d),
a AS (SELECT e.doc_id, sum(CASE WHEN v.id IS NULL THEN 1 ELSE 0 END) AS unk, sum(coalesce(v.id, 1)) AS s
      FROM e LEFT JOIN v ON e.word = v.word GROUP BY e.doc_id)
SELECT d.doc_id, (len(d.ws) + 1)::BIGINT AS n_tokens, coalesce(a.unk, 0)::BIGINT AS unknown,
       coalesce(a.s, 0)::BIGINT AS id_sum
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

# ---------------------------------------------------------------- evaluation
_Z = "(SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_CE = f"""z AS {_Z},
c AS (SELECT vec_id, label, i, {R.CAP} * tanh(x / {R.CAP}) AS x FROM z),
m AS (SELECT vec_id, max(x) AS m FROM c GROUP BY vec_id),
ce AS (SELECT c.vec_id, any_value(c.label) AS target,
              max(m.m) + ln(sum(exp(c.x - m.m))) - max(CASE WHEN c.i = c.label + 1 THEN c.x END) AS loss
       FROM c JOIN m ON c.vec_id = m.vec_id GROUP BY c.vec_id),
sq AS (SELECT vec_id // {R.EVAL_T} AS seq_index, avg(loss) AS seq_loss FROM ce GROUP BY 1)"""

SQL["cross_entropy"] = f"""
WITH {_CE}
SELECT vec_id, target::BIGINT AS target, round(loss, 6) AS loss FROM ce
"""

SQL["validation"] = f"""
WITH {_CE}
SELECT round(avg(seq_loss), 6) AS loss, round(exp(avg(seq_loss)), 6) AS perplexity,
       count(*)::BIGINT AS sequences, (count(*) * {R.EVAL_T})::BIGINT AS tokens FROM sq
"""

SQL["running_validation"] = f"""
WITH {_CE}
SELECT seq_index::BIGINT AS seq_index, (row_number() OVER (ORDER BY seq_index))::BIGINT AS processed,
       round(avg(seq_loss) OVER (ORDER BY seq_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss
FROM sq
"""

_CHOICES = """ch AS (SELECT 'task_' || CAST(label AS VARCHAR) AS task, vec_id * 16 + (i - 1) // 4 AS item_id,
                     (i - 1) % 4 AS choice, x AS loglik, (i - 1) % 4 + 1 + (i - 1) // 4 AS n_bytes,
                     (vec_id + (i - 1) // 4) % 4 AS gold
              FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
                    FROM embeddings))"""
_ACC = f"""{_CHOICES},
it AS (SELECT task, item_id, arg_max(choice, (loglik, -choice)) AS pick,
              arg_max(choice, (loglik / n_bytes, -choice)) AS pick_norm, any_value(gold) AS gold, count(*) AS nc
       FROM ch GROUP BY task, item_id),
t AS (SELECT task, count(*)::BIGINT AS items, avg(CASE WHEN pick = gold THEN 1.0 ELSE 0.0 END) AS acc,
             avg(CASE WHEN pick_norm = gold THEN 1.0 ELSE 0.0 END) AS acc_norm, avg(1.0 / nc) AS chance
      FROM it GROUP BY task)"""

SQL["choice_accuracy"] = f"""
WITH {_ACC}
SELECT task, items, round(acc, 6) AS acc, round(acc_norm, 6) AS acc_norm, round(acc, 6) AS accuracy,
       round(chance, 6) AS chance FROM t
"""

SQL["macro_accuracy"] = f"""
WITH {_ACC}
SELECT round(avg(acc), 6) AS macro_accuracy, sum(items)::BIGINT AS items,
       round(avg(acc - chance), 6) AS margin_over_chance FROM t
"""

SQL["limit_per_task"] = f"""
WITH {_CHOICES}, d AS (SELECT DISTINCT task, item_id FROM ch)
SELECT task, item_id FROM d QUALIFY row_number() OVER (PARTITION BY task ORDER BY item_id) <= {R.TASK_LIMIT}
"""

# ---------------------------------------------------------------- candidates
def _scores(temp: float) -> str:
    return (f"sc AS (SELECT vec_id AS ctx_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS cand_id, "
            f"unnest(embedding)::DOUBLE / {temp} AS score FROM embeddings)")


_SOFT = "exp(score - max(score) OVER (PARTITION BY ctx_id)) / sum(exp(score - max(score) OVER (PARTITION BY ctx_id))) OVER (PARTITION BY ctx_id)"

SQL["candidate_topk"] = f"""
WITH {_scores(1.0)}
SELECT ctx_id, cand_id, round(score, 6) AS score FROM sc
QUALIFY rank() OVER (PARTITION BY ctx_id ORDER BY score DESC) <= {R.TOPK}
"""

SQL["candidate_topp"] = f"""
WITH {_scores(R.TEMP)},
m0 AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM sc),
p AS (SELECT ctx_id, cand_id, score, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id) AS prob FROM m0),
k AS (SELECT ctx_id, cand_id, score FROM p
      QUALIFY coalesce(sum(prob) OVER (PARTITION BY ctx_id ORDER BY score DESC, cand_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {R.TOPP}),
m1 AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM k)
SELECT ctx_id, cand_id, round(exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id), 6) AS prob FROM m1
"""

SQL["candidate_minp"] = f"""
WITH {_scores(R.TEMP)}
SELECT ctx_id, cand_id FROM sc QUALIFY score >= max(score) OVER (PARTITION BY ctx_id) + ln({R.MINP})
"""

SQL["candidate_softmax"] = f"""
WITH {_scores(1.0)}, m AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM sc)
SELECT ctx_id, cand_id, round(exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id), 6) AS prob FROM m
"""

SQL["candidate_argmax"] = f"""
WITH {_scores(1.0)}
SELECT ctx_id, arg_max(cand_id, (score, -cand_id)) AS choice FROM sc GROUP BY ctx_id
"""

SQL["custom_selector"] = SQL["candidate_argmax"]


def _race(seed: int, sample: str) -> str:
    return (f"-ln((('0x' || substr(md5(concat_ws(':', {seed}, ctx_id, {sample}, cand_id)), 1, 8))::BIGINT + 0.5) "
            f"/ 4294967296.0) / prob")


SQL["candidate_sample"] = f"""
WITH {_scores(R.TEMP)},
k AS (SELECT * FROM sc QUALIFY rank() OVER (PARTITION BY ctx_id ORDER BY score DESC) <= 10),
m AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM k),
p AS (SELECT ctx_id, cand_id, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id) AS prob FROM m),
r AS (SELECT ctx_id, s AS sample, cand_id, prob FROM p, unnest(generate_series(1, {R.N_SAMPLES})) AS g(s) WHERE prob > 0)
SELECT ctx_id, sample::BIGINT AS sample, arg_min(cand_id, ({_race(R.SAMPLE_SEED, 'sample')}, cand_id)) AS choice
FROM r GROUP BY ctx_id, sample
"""

_HIST = f"h AS (SELECT doc_id AS ctx_id, list_transform({BYTES}[1:-2], lambda b: b % 64) AS ids FROM documents)"
# n = 3: positions whose two ids equal the history's last two ban the id after them
_BANNED = f"""hp AS (SELECT ctx_id, unnest(ids) AS id, unnest(range(len(ids))) AS i, len(ids) AS n FROM h),
hl AS (SELECT ctx_id, i, n, id AS a, lead(id, 1) OVER w AS b, lead(id, 2) OVER w AS c FROM hp
       WINDOW w AS (PARTITION BY ctx_id ORDER BY i)),
last2 AS (SELECT ctx_id, a, b FROM hl WHERE i = n - 2),
bn AS (SELECT DISTINCT hl.ctx_id, hl.c::BIGINT AS cand_id FROM hl JOIN last2 ON hl.ctx_id = last2.ctx_id
       AND hl.a = last2.a AND hl.b = last2.b WHERE hl.i <= hl.n - 3)"""
_POLICY_BASE = f"""{_scores(1.0)}, {_HIST},
seen AS (SELECT DISTINCT ctx_id, unnest(ids)::BIGINT AS cand_id FROM h),
{_BANNED},
pen AS (SELECT sc.ctx_id, sc.cand_id,
               CASE WHEN seen.cand_id IS NULL THEN sc.score WHEN sc.score < 0 THEN sc.score * {R.PENALTY}
                    ELSE sc.score / {R.PENALTY} END AS score
        FROM sc LEFT JOIN seen ON sc.ctx_id = seen.ctx_id AND sc.cand_id = seen.cand_id
        WHERE sc.cand_id < {R.VOCAB_REAL}),
ok AS (SELECT * FROM pen WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.ctx_id = pen.ctx_id AND bn.cand_id = pen.cand_id))"""

SQL["greedy_policy"] = f"""
WITH {_POLICY_BASE},
best AS (SELECT ctx_id, arg_max(cand_id, (score, -cand_id)) AS choice FROM ok GROUP BY ctx_id)
SELECT c.ctx_id, choice FROM (SELECT DISTINCT ctx_id FROM sc) c LEFT JOIN best ON c.ctx_id = best.ctx_id
"""

SQL["decode_policy"] = f"""
WITH {_POLICY_BASE},
t AS (SELECT ctx_id, cand_id, score / {R.TEMP} AS score FROM ok),
k AS (SELECT * FROM t QUALIFY rank() OVER (PARTITION BY ctx_id ORDER BY score DESC) <= 20),
k1 AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM k),
p1 AS (SELECT ctx_id, cand_id, score, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id) AS prob FROM k1),
tp AS (SELECT ctx_id, cand_id, score FROM p1
       QUALIFY coalesce(sum(prob) OVER (PARTITION BY ctx_id ORDER BY score DESC, cand_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.9),
mp AS (SELECT * FROM tp QUALIFY score >= max(score) OVER (PARTITION BY ctx_id) + ln(0.05)),
mm AS (SELECT *, max(score) OVER (PARTITION BY ctx_id) AS mx FROM mp),
p AS (SELECT ctx_id, cand_id, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY ctx_id) AS prob FROM mm)
SELECT c.ctx_id, choice FROM (SELECT DISTINCT ctx_id FROM sc) c LEFT JOIN (
  SELECT ctx_id, arg_min(cand_id, ({_race(R.POLICY_SEED, '0')}, cand_id)) AS choice FROM p WHERE prob > 0 GROUP BY ctx_id) x
  ON c.ctx_id = x.ctx_id
"""

SQL["ngram_loops"] = f"""
WITH t AS (SELECT 'documents' AS source, doc_id::VARCHAR AS text_id, {_WORDS} AS w FROM documents
           UNION ALL
           SELECT 'conversations' AS source, conv_id || '/' || turn AS text_id, {_WORDS} AS w FROM conversations),
g AS (SELECT source, text_id,
             CASE WHEN len(w) >= {R.NGRAM} THEN list_transform(range(1, len(w) - {R.NGRAM} + 2),
                  lambda i: w[i: i + {R.NGRAM - 1}]) ELSE [] END AS grams FROM t)
SELECT source, text_id, len(grams)::BIGINT AS ngrams, len(list_distinct(grams))::BIGINT AS distinct_ngrams,
       CASE WHEN len(grams) > 0 THEN round(1 - len(list_distinct(grams)) / len(grams), 6) ELSE 0.0 END AS repeated_share
FROM g
"""

_CONV_BYTES = BYTES.replace("|| [256]", "")
SQL["prompt_truncate"] = f"""
WITH c AS (SELECT conv_id, turn, {_CONV_BYTES} AS ids FROM conversations),
k AS (SELECT conv_id, turn, CASE WHEN len(ids) <= {max(1, R.PROMPT_T - R.MAX_NEW)} THEN ids
                                  ELSE ids[len(ids) - {max(1, R.PROMPT_T - R.MAX_NEW) - 1}:] END AS k FROM c)
SELECT conv_id, turn, len(k)::BIGINT AS n_kept, k[1]::BIGINT AS first_kept, coalesce(list_sum(k), 0)::BIGINT AS kept_sum
FROM k
"""

SQL["stop_at_eos"] = f"""
WITH c AS (SELECT conv_id, turn, {_CONV_BYTES} AS ids FROM conversations),
o AS (SELECT conv_id, turn, CASE WHEN list_position(ids, {R.STOP_ID}) IS NULL THEN ids
                                  ELSE ids[1: list_position(ids, {R.STOP_ID})] END AS o,
             (list_position(ids, {R.STOP_ID}) IS NOT NULL)::INTEGER AS has_eos FROM c),
p AS (SELECT *, max(len(o)) OVER (PARTITION BY conv_id) AS longest FROM o)
SELECT conv_id, turn, len(o)::BIGINT AS n_out, has_eos, longest::BIGINT AS padded_len,
       (coalesce(list_sum(o), 0) + (longest - len(o)) * {R.STOP_ID})::BIGINT AS padded_sum
FROM p
"""

# ---------------------------------------------------------------- telemetry
_CN = f"""ev AS (SELECT user_id AS run_id, event_id AS seq, epoch_us(ts) AS us, round(value * 100)::BIGINT AS added
       FROM events),
cn AS (SELECT run_id, seq, us, added,
              sum(added) OVER (PARTITION BY run_id, us // {R.DAY_US} ORDER BY us, seq)::BIGINT AS units FROM ev)"""
_W = int(R.RATE_WINDOW_S * 1_000_000)

SQL["rolling_rate"] = f"""
WITH {_CN},
l AS (SELECT *, lag(units) OVER (PARTITION BY run_id ORDER BY us, seq) AS pu FROM cn),
s AS (SELECT *, sum(CASE WHEN pu IS NOT NULL AND units < pu THEN 1 ELSE 0 END)
                  OVER (PARTITION BY run_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sg
      FROM l),
f AS (SELECT *, lag(us) OVER (PARTITION BY run_id, sg ORDER BY us, seq) AS pus,
              lag(units) OVER (PARTITION BY run_id, sg ORDER BY us, seq) AS pun,
              min(us) OVER (PARTITION BY run_id, sg ORDER BY us RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS fus,
              arg_min(units, us) OVER (PARTITION BY run_id, sg ORDER BY us
                                       RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS fun
      FROM s),
g AS (SELECT *, CASE WHEN pus < fus THEN pus ELSE fus END AS f_us, CASE WHEN pus < fus THEN pun ELSE fun END AS f_un
      FROM f),
r AS (SELECT *, CASE WHEN pus IS NULL OR (us - f_us) / 1e6 <= 0 THEN 0.0
                     ELSE greatest(0.0, (units - f_un) / ((us - f_us) / 1e6)) END AS rate,
             CASE WHEN pus IS NULL THEN 0.0 ELSE greatest((us - f_us) / 1e6, 0.0) END AS el FROM g)
SELECT run_id, seq, units, round(rate * 3600, 6) AS rate_per_hour, round(el, 6) AS elapsed_s,
       (CASE WHEN rate > 0 THEN floor(greatest(0.0, {R.RATE_TARGET} - units) / rate) ELSE 0 END)::BIGINT AS eta_s
FROM r
"""

SQL["counter_audit"] = f"""
WITH {_CN},
l AS (SELECT *, lag(units) OVER (PARTITION BY run_id ORDER BY us, seq) AS pu FROM cn),
v AS (SELECT run_id, seq, 'negative_delta' AS rule, 0.0 AS expected, added::DOUBLE AS found FROM l WHERE added < 0
      UNION ALL
      SELECT run_id, seq, 'delta_mismatch', added::DOUBLE, (units - pu)::DOUBLE FROM l
      WHERE pu IS NOT NULL AND units - pu <> added
      UNION ALL
      SELECT run_id, seq, 'backwards', pu::DOUBLE, units::DOUBLE FROM l WHERE pu IS NOT NULL AND units < pu)
SELECT run_id, seq, rule, round(expected, 6) AS expected, round(found, 6) AS found FROM v
"""

_LOG = """lg AS (SELECT user_id AS run_id, event_id AS step, value::DOUBLE AS train_loss,
              CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 END AS dev_loss,
              event_type = 'purchase' AS is_eval FROM events),
iv AS (SELECT *, coalesce(sum(is_eval::INTEGER) OVER (PARTITION BY run_id ORDER BY step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS interval FROM lg),
ia AS (SELECT run_id, interval, avg(train_loss) AS a FROM iv GROUP BY run_id, interval),
ev AS (SELECT iv.run_id, iv.step, iv.interval, iv.dev_loss, ia.a AS average_train_loss
       FROM iv JOIN ia ON iv.run_id = ia.run_id AND iv.interval = ia.interval WHERE iv.is_eval)"""

SQL["interval_average"] = f"""
WITH {_LOG}
SELECT run_id, step, interval::BIGINT AS interval, round(average_train_loss, 6) AS average_train_loss,
       round(min(dev_loss) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS best_dev_loss,
       round(min(average_train_loss) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING), 6)
         AS best_average_train_loss
FROM ev
"""

SQL["hold_last"] = f"""
WITH {_LOG},
h AS (SELECT run_id, step, is_eval,
             last_value(dev_loss IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
      FROM lg)
SELECT run_id, step, round(held, 6) AS held_dev_loss FROM h WHERE NOT is_eval
"""

_POL = " UNION ALL ".join(f"SELECT '{n}' AS name, '{p}' AS policy" for n, p in R.POLICY)
SQL["metric_summary"] = f"""
WITH pol AS ({_POL}),
a AS (SELECT user_id AS run_id, event_type AS name, arg_max(value, event_id) AS l, min(value) AS mn, max(value) AS mx
      FROM events GROUP BY user_id, event_type)
SELECT a.run_id, a.name, pol.policy,
       round(CASE pol.policy WHEN 'last' THEN l WHEN 'min' THEN mn ELSE mx END, 6) AS summary
FROM a JOIN pol ON a.name = pol.name
"""

SQL["loss_comparison"] = f"""
WITH {_LOG}
SELECT run_id, step, round(average_train_loss, 6) AS average_train_loss, round(dev_loss, 6) AS dev_loss FROM ev
"""

_TPS = R.SCHED["B"] * R.SCHED["grad_accum_steps"] * R.SCHED["T"]
SQL["run_summary"] = f"""
WITH {_LOG}
SELECT run_id, max(step) AS current_step, round(arg_max(train_loss, step), 6) AS latest_train_loss,
       round(arg_max(dev_loss, CASE WHEN is_eval THEN step END), 6) AS latest_dev_loss,
       round(min(CASE WHEN is_eval THEN dev_loss END), 6) AS best_dev_loss,
       sum(is_eval::INTEGER)::BIGINT AS evaluations, (max(step) * {_TPS})::BIGINT AS tokens_processed,
       round(100.0 * max(step) / {R.SCHED["max_steps"]}, 6) AS progress_percent,
       CASE WHEN max(step) >= {R.SCHED["max_steps"]} THEN 'finished' ELSE 'running' END AS status
FROM lg GROUP BY run_id
"""

SQL["throughput"] = f"""
WITH e AS (SELECT user_id AS run_id, epoch_us(ts) AS us, ts, event_type FROM events),
t AS (SELECT run_id, count(*) AS sequences, (max(us) - min(us)) / 1e6 AS el, arg_min(event_type, us) AS first_type,
             min(ts) AS start_ts FROM e GROUP BY run_id),
r AS (SELECT *, CASE WHEN el > 0 THEN sequences * {R.TPS_SEQ_LEN} / el ELSE 0.0 END AS tps FROM t)
SELECT run_id, sequences::BIGINT AS sequences, round(el, 6) AS elapsed_s, round(tps, 6) AS tokens_per_s,
       CASE WHEN isnan(tps) OR tps <= 0 OR isinf(tps) THEN '— tok/s'
            WHEN tps >= 1e9 THEN printf('%.2fG tok/s', tps / 1e9)
            WHEN tps >= 1e6 THEN printf('%.2fM tok/s', tps / 1e6)
            WHEN tps >= 1e3 THEN printf('%.1fk tok/s', tps / 1e3)
            ELSE printf('%.1f tok/s', tps) END AS rate_text,
       CASE WHEN first_type = 'signup' THEN strftime(start_ts, '%Y%m%d-%H%M%S') || '-pretraining'
            ELSE 'pretraining' END AS run_name
FROM r
"""

_G = int(R.THROTTLE_GAP_S * 1_000_000)
SQL["throttle"] = f"""
WITH RECURSIVE {_CN},
nx AS (SELECT c.run_id, c.seq, c.us, c.units,
              (SELECT min(d.seq) FROM cn d WHERE d.run_id = c.run_id AND d.seq > c.seq
                 AND (d.us >= c.us + {_G} OR d.units >= {R.THROTTLE_TARGET})) AS nxt
       FROM cn c),
ch AS (SELECT run_id, seq, nxt FROM nx WHERE (run_id, seq) IN (SELECT run_id, min(seq) FROM cn GROUP BY run_id)
       UNION ALL
       SELECT nx.run_id, nx.seq, nx.nxt FROM ch JOIN nx ON nx.run_id = ch.run_id AND nx.seq = ch.nxt)
SELECT ch.run_id, ch.seq, cn.units FROM ch JOIN cn ON cn.run_id = ch.run_id AND cn.seq = ch.seq
"""

_S = R.SCHED
_DEC = int(0.8 * _S["max_steps"])
SQL["wsd_schedule"] = f"""
SELECT event_id AS step,
       round(CASE WHEN event_id < {_S["warmup_steps"]} THEN {_S["learning_rate"]} * (event_id + 1) / {_S["warmup_steps"]}
                  WHEN event_id < {_DEC} THEN {_S["learning_rate"]}
                  ELSE {_S["min_lr"]} + (1.0 - (event_id - {_DEC}) / {max(1, _S["max_steps"] - _DEC)})
                       * ({_S["learning_rate"]} - {_S["min_lr"]}) END, 12) AS lr,
       round(0.04 * (CASE WHEN event_id < {_S["warmup_steps"]} THEN {_S["learning_rate"]} * (event_id + 1) / {_S["warmup_steps"]}
                  WHEN event_id < {_DEC} THEN {_S["learning_rate"]}
                  ELSE {_S["min_lr"]} + (1.0 - (event_id - {_DEC}) / {max(1, _S["max_steps"] - _DEC)})
                       * ({_S["learning_rate"]} - {_S["min_lr"]}) END / {_S["learning_rate"]}), 12) AS matrix_lr,
       (event_id % {_S["eval_interval"]} = 0 OR event_id = {_S["max_steps"]})::INTEGER AS is_eval,
       (event_id * {_S["grad_accum_steps"]} // 572)::BIGINT AS epoch,
       (event_id * {_S["grad_accum_steps"]} % 572)::BIGINT AS batch_offset,
       (event_id * {_TPS})::BIGINT AS tokens_processed,
       round(100.0 * event_id / {_S["max_steps"]}, 6) AS progress_percent
FROM events
"""

# ---------------------------------------------------------------- artifacts and audits
SQL["shard_roundtrip"] = SQL["pack_windows"]

SQL["corpus_totals"] = f"""
SELECT {NCOMM}::BIGINT AS shards, ({NCOMM} * {R.S})::BIGINT AS tokens,
       round({NCOMM} * {R.S} * 2 / {float(1 << 30)}, 6) AS gib
"""

SQL["audit_manifest"] = f"""
WITH {_OFFS},
segs AS (SELECT s AS shard, least(start + n, (s + 1) * {R.S}) - greatest(start, s * {R.S}) AS t
         FROM offs, unnest(generate_series(start // {R.S}, (start + n - 1) // {R.S})) AS g(s)),
st AS (SELECT shard, sum(t)::BIGINT AS tokens FROM segs GROUP BY shard),
idx AS (SELECT unnest(generate_series(0, (SELECT max(shard) FROM st) + {R.CLAIMED_EXTRA})) AS shard),
j AS (SELECT idx.shard, st.tokens FROM idx LEFT JOIN st ON idx.shard = st.shard)
SELECT shard::BIGINT AS shard, 'file_missing' AS rule, CAST({2 * R.S} AS VARCHAR) AS expected, NULL::VARCHAR AS found
FROM j WHERE tokens IS NULL
UNION ALL
SELECT shard::BIGINT, 'file_size', CAST({2 * R.S} AS VARCHAR), CAST(tokens * 2 AS VARCHAR) FROM j
WHERE tokens IS NOT NULL AND tokens * 2 <> {2 * R.S}
UNION ALL
SELECT shard::BIGINT, 'meta_missing', 'metadata', NULL FROM j WHERE tokens IS NULL
UNION ALL
SELECT shard::BIGINT, 'meta_mismatch', CAST(shard AS VARCHAR) || '/{R.S}/uint16',
       CAST(shard AS VARCHAR) || '/' || CAST(tokens AS VARCHAR) || '/uint16'
FROM j WHERE tokens IS NOT NULL AND tokens <> {R.S}
"""

SQL["resume_build"] = SQL["pack_windows"]
SQL["resume_source"] = SQL["pack_windows"]

SQL["build_progress"] = f"""
WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n, {CAP} AS cap FROM documents),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, sum({NTOK}) OVER (ORDER BY doc_id) AS e FROM documents),
f AS (SELECT count(*) AS n0 FROM documents, b WHERE doc_id < lo + (hi - lo + 1) // 3),
c AS (SELECT g.j + 1 AS commit_id, least(n0 + g.j * ((n + 2) // 3), n) AS upto, n0 + (g.j - 1) * ((n + 2) // 3) AS before, cap
      FROM b, f, unnest(generate_series(0, 3)) AS g(j)),
stop AS (SELECT min(i) AS last_used FROM d, b WHERE e >= cap * {R.S}),
k AS (SELECT commit_id, least(upto, last_used) AS used, cap FROM c, stop WHERE commit_id = 1 OR (before < last_used AND before < (SELECT n FROM b)))
SELECT commit_id::BIGINT AS commit_id, least(cap, coalesce(e, 0) // {R.S})::BIGINT AS next_shard,
       (least(cap, coalesce(e, 0) // {R.S}) * {R.S})::BIGINT AS committed_tokens,
       (coalesce(e, 0) - least(cap, coalesce(e, 0) // {R.S}) * {R.S})::BIGINT AS pending_tokens,
       used::BIGINT AS source_documents_consumed, doc_id AS last_doc_id, (least(cap, coalesce(e, 0) // {R.S}) = cap)::INTEGER AS complete
FROM k LEFT JOIN d ON d.i = k.used
"""

SQL["odd_ids"] = f"""
WITH o AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id // 3 END AS doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS text_key,
                  {NTOK}::BIGINT AS n_tokens FROM documents)
SELECT doc_id, text_key, n_tokens,
       (sum(n_tokens) OVER (ORDER BY doc_id NULLS FIRST, text_key, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS start,
       sum(n_tokens) OVER (ORDER BY doc_id NULLS FIRST, text_key, n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM o
"""

SQL["dev_rotation"] = f"""
WITH {_CE},
b AS (SELECT seq_index // {R.DEV_ROWS} AS batch, seq_index, seq_loss FROM sq),
kept AS (SELECT vec_id // {R.EVAL_T} AS seq_index, count(loss) AS n FROM ce GROUP BY 1),
p AS (SELECT max(batch) + 1 AS n, least({R.ROTATION_BATCHES}, max(batch) + 1) AS k FROM b),
e AS (SELECT j AS eval_no, (j * k + i) % n AS batch, ((j + 1) * k) % n AS cursor_after
      FROM p, unnest(generate_series(0, n // {R.ROTATION_BATCHES} + 1)) AS a(j), unnest(generate_series(0, {R.ROTATION_BATCHES - 1})) AS c(i) WHERE i < k)
SELECT e.eval_no::BIGINT AS eval_no, e.cursor_after::BIGINT AS cursor_after, round(sum(seq_loss * kept.n) / sum(kept.n), 6) AS sampled_loss,
       sum(kept.n)::BIGINT AS tokens, count(DISTINCT e.batch)::BIGINT AS batches
FROM e JOIN b ON e.batch = b.batch JOIN kept ON kept.seq_index = b.seq_index GROUP BY e.eval_no, e.cursor_after
"""

_F = f"""sh AS (SELECT unnest(generate_series(0, {NCOMM} - 1))::BIGINT AS shard),
k AS (SELECT shard, shard % 7 AS kind, 'shard_' || lpad(shard::VARCHAR, 5, '0') || '.bin' AS path,
             CASE shard % 7 WHEN 4 THEN {2 * R.S - 2} WHEN 2 THEN {2 * R.S + 1} ELSE {2 * R.S} END AS len FROM sh),
last AS (SELECT octet_length(encode(text)) AS n FROM documents ORDER BY doc_id DESC LIMIT 1)"""
SQL["audit_faults"] = f"""
WITH {_F}
SELECT 'A2' AS audit, NULL::BIGINT AS shard, 'incomplete' AS rule, {NCOMM} || '/' || {NCOMM} * {R.S} AS expected,
       ({NCOMM} - 1) || '/' || ({NCOMM} - 1) * {R.S} AS found
UNION ALL SELECT 'A2', shard, 'file_missing', '{2 * R.S}', NULL FROM k WHERE kind = 3
UNION ALL SELECT 'A2', shard, 'file_size', '{2 * R.S}', len::VARCHAR FROM k WHERE kind IN (2, 4)
UNION ALL SELECT 'A2', shard, 'meta_missing', 'metadata', NULL FROM k WHERE kind = 5
UNION ALL SELECT 'A2', shard, 'meta_mismatch', shard || '/{R.S}/uint16', shard || '/{R.S}/int32' FROM k WHERE kind = 6
UNION ALL SELECT 'A2 empty', NULL, 'state_missing', 'state', NULL
UNION ALL SELECT 'A3', shard, 'orphan_outputs', 'state', path FROM k WHERE kind <> 3
UNION ALL SELECT 'A4', NULL, 'config_drift', 'dataset_config=default', 'dataset_config=other'
UNION ALL SELECT 'A5', NULL, 'pending_mismatch', '0', n::VARCHAR FROM last WHERE n > 0
UNION ALL SELECT 'A5 gone', NULL, 'pending_missing', 'p', NULL
UNION ALL SELECT 'A7', NULL, 'seed_drift', '{R.CONFIG_SEED}', '{R.CONFIG_SEED + 1}' FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT 'A7', NULL, 'unknown_config', 'known field', 'mystery' FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT 'odd', shard, 'odd_length', 'even', len::VARCHAR FROM k WHERE kind = 2
"""

_LR = (f"CASE WHEN {{0}} < {_S['warmup_steps']} THEN {_S['learning_rate']} * ({{0}} + 1) / {_S['warmup_steps']} "
       f"WHEN {{0}} < {_DEC} THEN {_S['learning_rate']} ELSE {_S['min_lr']} + (1.0 - ({{0}} - {_DEC}) / {max(1, _S['max_steps'] - _DEC)}) "
       f"* ({_S['learning_rate']} - {_S['min_lr']}) END")
SQL["run_report"] = f"""
WITH {_LOG},
g AS (SELECT user_id AS run_id, max(event_id) AS current_step, max(event_id) - min(event_id) AS steps,
             (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS el FROM events GROUP BY user_id),
a AS (SELECT run_id, arg_max(average_train_loss, step) AS l, min(average_train_loss) AS b FROM ev GROUP BY run_id),
r AS (SELECT g.*, l, b, CASE WHEN el > 0 THEN steps / el ELSE 0.0 END AS sps FROM g LEFT JOIN a ON g.run_id = a.run_id)
SELECT run_id, current_step, round(l, 6) AS latest_average_train_loss, round(b, 6) AS best_average_train_loss,
       round({_LR.format('current_step')}, 12) AS learning_rate, round(el, 6) AS elapsed_s, round(sps, 9) AS steps_per_s,
       round(sps * {_TPS}, 3) AS tokens_per_s,
       (CASE WHEN sps > 0 THEN floor(greatest(0, {_S["max_steps"]} - current_step) / sps) ELSE 0 END)::BIGINT AS eta_s
FROM r
"""

_WIN = SQL["pack_windows"].split("SELECT (shard *")[0]
SQL["windows_xy"] = f"""{_WIN}
SELECT (shard * {NW} + k)::BIGINT AS seq_index, (count(*) - 1)::BIGINT AS n_x,
       (sum(tok) - arg_max(tok, p))::BIGINT AS x_sum, (sum(tok) - arg_min(tok, p))::BIGINT AS y_sum, arg_max(tok, p)::BIGINT AS last_y
FROM win GROUP BY shard, k
"""

SQL["checked_ids"] = f"""
SELECT doc_id, (len(ids) - 1)::BIGINT AS n_ids, list_max(ids[1:len(ids) - 1])::BIGINT AS max_id
FROM (SELECT doc_id, {BYTES} AS ids FROM documents)
"""

SQL["word_lists"] = """
WITH p AS (SELECT doc_id, unnest(string_split('all,' || text, ',')) AS x,
                  generate_subscripts(string_split('all,' || text, ','), 1) AS i FROM documents),
t AS (SELECT doc_id, trim(x, e'\\t\\n\\x0b\\f\\r ') AS x, min(i) AS i FROM p WHERE trim(x, e'\\t\\n\\x0b\\f\\r ') <> '' GROUP BY 1, 2)
SELECT doc_id, count(*)::BIGINT AS names, string_agg(x, '|' ORDER BY i) AS list FROM t GROUP BY doc_id
"""

SQL["cross_entropy_long"] = f"""
WITH z AS {_Z}, m AS (SELECT vec_id, max(x) AS m FROM z GROUP BY vec_id)
SELECT z.vec_id AS ctx_id, round(max(m.m) + ln(sum(exp(z.x - m.m))) - max(CASE WHEN z.i = z.label + 1 THEN z.x END), 6) AS loss
FROM z JOIN m ON z.vec_id = m.vec_id GROUP BY z.vec_id
"""

SQL["artifact_tables"] = f"""
SELECT s::BIGINT AS shard, {2 * R.S}::BIGINT AS bytes, 'shard_' || lpad(s::VARCHAR, 5, '0') || '.bin' AS file, {R.S}::BIGINT AS tokens,
       257::BIGINT AS vocab_size, 'uint16' AS dtype, 'utf-8' AS tokenizer_revision
FROM unnest(generate_series(0, {NCOMM} - 1)) AS g(s)
"""

SQL["window_fetch"] = f"""
WITH l AS ({SQL["window_lookup"]}), w AS ({SQL["pack_windows"]})
SELECT l.doc_id, l.idx, l.shard, l.k, l.out_of_range, w.window_md5 FROM l LEFT JOIN w ON l.shard = w.shard AND l.k = w.k
"""

SQL["published_files"] = f"""
WITH s AS (SELECT unnest(generate_series(0, {NCOMM} - 1)) AS n),
f AS (SELECT n, 'shard_' || lpad(n::VARCHAR, 5, '0') || '.bin' AS file, {2 * R.S}::BIGINT AS bytes,
             CASE n WHEN 0 THEN 'damaged' WHEN 1 THEN 'size' ELSE 'ok' END AS found FROM s
      UNION ALL SELECT n, 'shard_' || lpad(n::VARCHAR, 5, '0') || '_meta.json', NULL, CASE n WHEN 0 THEN 'missing' ELSE 'ok' END FROM s)
SELECT file, bytes, found, (found <> 'ok')::INTEGER AS copied, 'ok' AS status FROM f
"""

SQL["rank_export"] = f"""
WITH p AS ({SQL["remaining_plan"]})
SELECT epoch, 1::BIGINT AS rank, batch // {R.RANK_BATCHES} AS part, batch, step, position, local_index FROM p WHERE batch % {R.WORLD} = 1
"""

SQL["metric_rows"] = """
SELECT user_id AS run_id, event_type AS name, count(*)::BIGINT AS rows, round(sum(value), 4) AS total, max(event_id) AS last_step,
       max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2
"""

SQL["summary_file"] = SQL["validation"]

SQL["config_rows"] = """
SELECT doc_id, doc_id % 5 AS batch, length(text)::BIGINT AS seq_len, floor(doc_id * 10 * 0.8)::BIGINT AS decay_start, round(doc_id % 7 / 10000.0, 6) AS learning_rate,
       concat_ws(',', CASE WHEN doc_id % 5 <= 0 THEN 'B' END, CASE WHEN length(text) <= 0 THEN 'T' END, CASE WHEN doc_id * 10 <= 0 THEN 'max_steps' END,
                 CASE WHEN doc_id % 7 <= 0 THEN 'learning_rate' END, CASE WHEN doc_id % 4 - 1 < 0 THEN 'warmup_steps' END) AS faults
FROM documents
"""

SQL["split_sizes"] = f"""
WITH n AS (SELECT doc_id, greatest(0, ({NTOK} - {R.T + 1}) // {R.ONE_STRIDE} + 1)::BIGINT AS n FROM documents),
t AS (SELECT doc_id, n, floor(0.95 * n)::BIGINT AS train FROM n),
d AS (SELECT doc_id, train, n - least(n, train + {(R.T + R.ONE_STRIDE - 1) // R.ONE_STRIDE}) AS dev FROM t)
SELECT doc_id, train, dev, (train = 0 OR dev = 0)::INTEGER AS refused FROM d
"""

SQL["pinned_encoder"] = f"""
WITH {_VOCAB},
r AS (SELECT sha256(string_agg(x, ',' ORDER BY x)) AS revision FROM (SELECT id || ':' || hex(word) AS x FROM v)),
w AS ({SQL["word_encode"]})
SELECT doc_id, n_tokens, id_sum, revision FROM w, r
"""

SQL["live_rate"] = SQL["rolling_rate"]
SQL["live_throttle"] = SQL["throttle"]
