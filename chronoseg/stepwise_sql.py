"""SQL of the queries whose steps depend on each other: recursive tables that carry a list or a mark as their state.

Each function takes what stands after WITH (tables of the sequences) and gives a whole statement. Tables that a function
reads are named in its docstring.
"""

from __future__ import annotations

DIMS = "range(1, 65)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform({DIMS}, lambda i: {a}[i] * {b}[i]))"


def unit(m: str) -> str:
    return f"list_transform({m}, lambda x: x / sqrt(list_sum(list_transform({m}, lambda y: y * y))))"


def suppressed_blocks(scored: str, threshold: float, gap: int) -> str:
    """cs (video_id, frame, cut_score). Tables up to sup (video_id, cut, raw_frame, score): of each run above the threshold
    the best frame, unless the run ends within the gap of the one taken last."""
    return f"""{scored},
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY video_id ORDER BY frame) AS island FROM cs WHERE cut_score > {threshold}),
blk AS (SELECT video_id, max(frame) AS till, arg_max(frame, struct_pack(s := cut_score, f := -frame)) AS best, max(cut_score) AS score,
  row_number() OVER (PARTITION BY video_id ORDER BY min(frame)) AS rn FROM isl GROUP BY video_id, island),
mk AS (SELECT video_id, rn, best AS mark, true AS taken FROM blk WHERE rn = 1 UNION ALL
  SELECT b.video_id, b.rn, CASE WHEN b.till > m.mark + {gap} THEN b.best ELSE m.mark END, b.till > m.mark + {gap} FROM mk m JOIN blk b ON b.video_id = m.video_id AND b.rn = m.rn + 1),
sup AS (SELECT video_id, best - 1 AS cut, best AS raw_frame, score FROM mk JOIN blk USING (video_id, rn) WHERE taken AND best > 1)"""


def min_segment(tables: str, cuts: str, least: int) -> str:
    """A table of cuts (video_id, cut, total) without those nearer than `least` to the last kept or the end."""
    return f"""WITH RECURSIVE {tables}, c AS (SELECT video_id, cut, total, row_number() OVER (PARTITION BY video_id ORDER BY cut) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM {cuts}),
far AS (SELECT video_id, rn, CASE WHEN cut >= {least} THEN cut ELSE 0 END AS mark, cut >= {least} AS kept FROM c WHERE rn = 1 UNION ALL
  SELECT c.video_id, c.rn, CASE WHEN c.cut - f.mark >= {least} THEN c.cut ELSE f.mark END, c.cut - f.mark >= {least} FROM far f JOIN c ON c.video_id = f.video_id AND c.rn = f.rn + 1),
k AS (SELECT c.*, kept, max(CASE WHEN kept THEN cut END) OVER (PARTITION BY c.video_id) AS top FROM c JOIN far USING (video_id, rn))
SELECT video_id, cut, total FROM k WHERE n < 2 OR (kept AND NOT (cut = top AND total - 1 - cut < {least}))"""


def _taken(name: str, ranked: str, near: str, most: int) -> str:
    """Tables: of ranked (video_id, rn, frame) the frames that are near none taken before, `most` at most, in order."""
    return f"""{name}_w AS (SELECT video_id, rn, [frame] AS taken FROM {ranked} WHERE rn = 1 UNION ALL
  SELECT p.video_id, p.rn, CASE WHEN len(w.taken) < {most} AND len(list_filter(w.taken, lambda t: abs(t - p.frame) {near})) = 0 THEN list_append(w.taken, p.frame) ELSE w.taken END
  FROM {name}_w w JOIN {ranked} p ON p.video_id = w.video_id AND p.rn = w.rn + 1),
{name} AS (SELECT video_id, arg_max(taken, rn) AS taken FROM {name}_w GROUP BY 1)"""


def greedy_nms(frames: str, threshold: float, around: int, half: int, radius: int, most: int) -> str:
    """fr (video_id, frame, score). Events around the local maxima taken by falling normalised score."""
    return f"""WITH RECURSIVE {frames}, top AS (SELECT video_id, quantile_cont(score, 0.99) AS top FROM fr GROUP BY 1),
nm AS (SELECT video_id, frame, CASE WHEN top > 0 THEN score / top ELSE 0.0 END AS norm FROM fr JOIN top USING (video_id)),
wd AS (SELECT *, max(norm) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN {around} PRECEDING AND {around} FOLLOWING) AS best, count(*) OVER (PARTITION BY video_id) AS total FROM nm),
pk AS (SELECT video_id, frame, norm, total, row_number() OVER (PARTITION BY video_id ORDER BY norm DESC, frame) AS rn FROM wd WHERE norm = best AND norm >= {threshold} AND frame >= {around} AND frame < total - {around}),
{_taken("tk", "pk", f"<= {radius}", most)},
ev AS (SELECT video_id, unnest(range(1, len(taken) + 1)) AS event_id, unnest(taken) AS center FROM tk),
sp AS (SELECT ev.*, norm, greatest(center - {half}, 0) AS "start", least(center + {half}, total - 1) AS "end" FROM ev JOIN pk ON pk.video_id = ev.video_id AND pk.frame = ev.center)
SELECT video_id, event_id, center, "start", "end", round(norm, 6) AS score, ("start" + "end") // 2 AS representative_frame FROM sp"""


def peaks(signal: str, distance: int) -> str:
    """sig (video_id, frame, x). Tables up to peaks (video_id, frame, x): middles of strict local maxima of the height of
    the median of positive values, thinned from the highest down, of the prominence of their upper quartile."""
    return f"""{signal},
lv AS (SELECT video_id, quantile_cont(x, 0.75) AS prominence, quantile_cont(x, 0.5) AS height FROM sig WHERE x > 0 GROUP BY 1),
ch AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY video_id ORDER BY frame) THEN 0 ELSE 1 END AS fresh FROM sig),
pl AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame) AS g FROM ch),
flat AS (SELECT video_id, g, (min(frame) + max(frame)) // 2 AS frame, any_value(x) AS x FROM pl GROUP BY 1, 2),
nb AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after FROM flat WINDOW w AS (PARTITION BY video_id ORDER BY g)),
cand AS (SELECT nb.video_id, frame, x, row_number() OVER (PARTITION BY nb.video_id ORDER BY x DESC, frame DESC) AS rn FROM nb JOIN lv USING (video_id) WHERE before < x AND after < x AND x >= height),
{_taken("thin", "cand", f"< {distance}", 10**9)},
stay AS (SELECT video_id, unnest(taken) AS frame FROM thin),
higher AS (SELECT s.video_id, s.frame, p.x, coalesce(max(f.frame) FILTER (WHERE f.frame < s.frame AND f.x > p.x), -1) AS l, coalesce(min(f.frame) FILTER (WHERE f.frame > s.frame AND f.x > p.x), 1000000000000) AS r
  FROM stay s JOIN sig p ON p.video_id = s.video_id AND p.frame = s.frame JOIN sig f ON f.video_id = s.video_id GROUP BY 1, 2, 3),
low AS (SELECT h.video_id, h.frame, h.x, min(f.x) FILTER (WHERE f.frame > l AND f.frame <= h.frame) AS a, min(f.x) FILTER (WHERE f.frame < r AND f.frame >= h.frame) AS b
  FROM higher h JOIN sig f ON f.video_id = h.video_id GROUP BY 1, 2, 3),
peaks AS (SELECT video_id, frame, x FROM low JOIN lv USING (video_id) WHERE x - greatest(a, b) >= prominence)"""


def peak_zones(signal: str, distance: int, least: int, most: int) -> str:
    """sig (video_id, frame, x). What lies between peaks; pieces shorter than `least` go to the zone before."""
    return f"""WITH RECURSIVE {peaks(signal, distance)}, n AS (SELECT video_id, count(*) AS n FROM sig GROUP BY 1),
pk AS (SELECT p.* FROM peaks p JOIN n USING (video_id) WHERE n >= 2 * {distance}),
bd AS (SELECT video_id, 0 AS a FROM n UNION SELECT video_id, n - 1 FROM n UNION SELECT video_id, frame FROM pk),
pc AS (SELECT video_id, a, lead(a) OVER w AS b, row_number() OVER w AS i FROM bd WINDOW w AS (PARTITION BY video_id ORDER BY a)),
tp AS (SELECT pc.video_id, pc.a, b, i, b - pc.a + 1 >= {least} AS long, max(x) AS top FROM pc JOIN sig ON sig.video_id = pc.video_id AND frame BETWEEN a AND b GROUP BY ALL),
zn AS (SELECT *, sum(CASE WHEN long OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a) AS z FROM tp)
SELECT video_id, min(a) AS "start", max(b) AS "end", CASE WHEN video_id IN (SELECT video_id FROM pk) AND arg_min(long, a) THEN arg_min(top, a) ELSE 0.0 END AS score FROM zn WHERE z <= {most} GROUP BY video_id, z"""


def ema_boundaries(vectors: str, similar: float, keep: float) -> str:
    """un (video_id, shot_id, u)."""
    return f"""WITH RECURSIVE {vectors}, v AS (SELECT video_id, shot_id, u, row_number() OVER (PARTITION BY video_id ORDER BY shot_id) AS rn FROM un),
em AS (SELECT video_id, rn, shot_id, u AS c, false AS boundary FROM v WHERE rn = 1 UNION ALL
  SELECT video_id, rn, shot_id, {unit("m")}, boundary FROM (SELECT v.video_id, v.rn, v.shot_id, list_transform({DIMS}, lambda i: {keep} * e.c[i] + {1 - keep} * v.u[i]) AS m, {dot("e.c", "v.u")} < {similar} AS boundary
    FROM em e JOIN v ON v.video_id = e.video_id AND v.rn = e.rn + 1))
SELECT video_id, shot_id, boundary, CAST(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY shot_id) AS BIGINT) AS scene_id FROM em"""


def leader_dedup(vectors: str, size: int, similar: float) -> str:
    """un; shots of `size` vectors. Each row's leader is the first leader whose cosine is above `similar`, else itself; of
    each leader's rows the one nearest to their mean stays."""
    return f"""WITH RECURSIVE {vectors}, g AS (SELECT video_id, shot_id // {size} AS shot, shot_id AS frame, u, row_number() OVER (PARTITION BY video_id, shot_id // {size} ORDER BY shot_id) AS rn FROM un),
ld AS (SELECT video_id, shot, rn, [struct_pack(rn := rn, u := u)] AS heads, rn AS own FROM g WHERE rn = 1 UNION ALL
  SELECT video_id, shot, rn, CASE WHEN f IS NULL THEN list_append(heads, struct_pack(rn := rn, u := u)) ELSE heads END, coalesce(f.rn, rn)
  FROM (SELECT g.video_id, g.shot, g.rn, g.u, l.heads, list_filter(l.heads, lambda h: {dot("h.u", "g.u")} > {similar})[1] AS f FROM ld l JOIN g ON g.video_id = l.video_id AND g.shot = l.shot AND g.rn = l.rn + 1)),
own AS (SELECT g.*, own FROM g JOIN ld USING (video_id, shot, rn)),
dm AS (SELECT video_id, shot, own, i, avg(u[i]) AS m FROM own, {DIMS} AS r(i) GROUP BY 1, 2, 3, 4), ml AS (SELECT video_id, shot, own, list(m ORDER BY i) AS m FROM dm GROUP BY 1, 2, 3),
ce AS (SELECT video_id, shot, own, {unit("m")} AS c FROM ml),
best AS (SELECT video_id, shot, own, arg_max(frame, struct_pack(s := round({dot("u", "c")}, 9), f := -frame)) AS frame FROM own JOIN ce USING (video_id, shot, own) GROUP BY 1, 2, 3),
n AS (SELECT video_id, shot, count(*) AS n FROM g GROUP BY 1, 2)
SELECT video_id, shot AS shot_id, frame, count(*) OVER (PARTITION BY video_id, shot) AS n_regions, n - count(*) OVER (PARTITION BY video_id, shot) AS n_dropped FROM best JOIN n USING (video_id, shot)"""


def content_dedup(vectors: str, size: int, most_mse: float) -> str:
    """vec (video_id, shot_id, e); shots of `size` vectors with scores from 0 to 4. The state is the list of slots."""
    return f"""WITH RECURSIVE {vectors}, g AS (SELECT video_id, shot_id // {size} AS shot, struct_pack(frame := shot_id, score := CAST(shot_id * 7 % 5 AS DOUBLE), e := e) AS x,
  row_number() OVER (PARTITION BY video_id, shot_id // {size} ORDER BY shot_id) AS rn FROM vec),
sl AS (SELECT video_id, shot, rn, [x] AS kept FROM g WHERE rn = 1 UNION ALL
  SELECT video_id, shot, rn, CASE WHEN f IS NULL THEN list_append(kept, x) WHEN x.score > kept[f].score THEN list_transform(range(1, len(kept) + 1), lambda s: CASE WHEN s = f THEN x ELSE kept[s] END) ELSE kept END
  FROM (SELECT g.video_id, g.shot, g.rn, g.x, s.kept, list_filter(range(1, len(s.kept) + 1), lambda k: list_sum(list_transform({DIMS}, lambda i: (g.x.e[i] - s.kept[k].e[i]) ** 2)) / 64 < {most_mse})[1] AS f
    FROM sl s JOIN g ON g.video_id = s.video_id AND g.shot = s.shot AND g.rn = s.rn + 1)),
fin AS (SELECT video_id, shot, unnest(arg_max(kept, rn)) AS x FROM sl GROUP BY 1, 2)
SELECT video_id, shot AS shot_id, x.frame AS frame, x.score AS score, row_number() OVER (PARTITION BY video_id, shot ORDER BY x.score DESC, x.frame) = 1 AS representative FROM fin"""


def short_merge(tables: str, least: int, similar: float) -> str:
    """sv (video_id, shot_id, start, end, u). A pass joins pieces to neighbours: who was joined to from the left is left out,
    so of pieces in a row that all go right every other one does."""
    return f"""WITH RECURSIVE {tables}, sh AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY shot_id) AS rn FROM sv),
ad AS (SELECT a.video_id, a.rn, {dot("a.u", "b.u")} AS sim FROM sh a JOIN sh b ON b.video_id = a.video_id AND b.rn = a.rn + 1),
ps AS (SELECT video_id, 0 AS pass, rn AS i, rn AS f, rn AS l, "start" AS s, "end" AS e, true AS more FROM sh UNION ALL
  SELECT video_id, pass + 1, row_number() OVER (PARTITION BY video_id ORDER BY min(f)), min(f), max(l), min(s), max(e), any_value(more)
  FROM (SELECT *, sum(CASE WHEN skip OR want = -1 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY i) AS g, bool_or(want <> 0 AND NOT skip) OVER (PARTITION BY video_id) AS more
    FROM (SELECT *, (i - 1 - coalesce(max(CASE WHEN want <> 1 THEN i END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS skip
      FROM (SELECT ps.video_id, pass, i, f, l, s, e, CASE WHEN e - s + 1 >= {least} OR greatest(coalesce(p.sim, -1), coalesce(q.sim, -1)) < {similar} THEN 0 WHEN coalesce(p.sim, -1) >= coalesce(q.sim, -1) THEN -1 ELSE 1 END AS want
        FROM ps LEFT JOIN ad p ON p.video_id = ps.video_id AND p.rn = f - 1 LEFT JOIN ad q ON q.video_id = ps.video_id AND q.rn = l WHERE ps.more)))
  GROUP BY video_id, pass, g),
last AS (SELECT video_id, max(pass) AS pass FROM ps GROUP BY 1)
SELECT ps.video_id, ps.i - 1 AS scene_id, list(sh.shot_id ORDER BY sh.rn) AS shot_ids, any_value(ps.s) AS "start", any_value(ps.e) AS "end"
FROM ps JOIN last USING (video_id, pass) JOIN sh ON sh.video_id = ps.video_id AND sh.rn BETWEEN f AND l GROUP BY ps.video_id, ps.i"""


def best_pair_merge(tables: str, similar: float) -> str:
    """sv (video_id, shot_id, start, end, e)."""
    cosine = f"""{dot("p[k].v", "p[k + 1].v")} / sqrt({dot("p[k].v", "p[k].v")} * {dot("p[k + 1].v", "p[k + 1].v")})"""
    return f"""WITH RECURSIVE {tables}, st AS (SELECT video_id, 0 AS step, list(struct_pack(s := "start", t := "end", v := e) ORDER BY "start") AS p FROM sv GROUP BY 1 UNION ALL
  SELECT video_id, step + 1, list_concat(p[1:j - 1], [struct_pack(s := p[j].s, t := p[j + 1].t, v := list_transform({DIMS}, lambda i: (p[j].v[i] + p[j + 1].v[i]) / 2))], p[j + 2:])
  FROM (SELECT *, list_position(sims, list_max(sims)) AS j FROM (SELECT video_id, step, p, list_transform(range(1, len(p)), lambda k: {cosine}) AS sims FROM st WHERE len(p) > 1)) WHERE list_max(sims) >= {similar}),
fin AS (SELECT video_id, unnest(arg_max(p, step)) AS x FROM st GROUP BY 1)
SELECT video_id, x.s AS "start", x.t AS "end" FROM fin"""


def shortest_first(shots: str, least: int) -> str:
    """shots (video_id, start, end) that tile each video."""
    return f"""WITH RECURSIVE {shots}, st AS (SELECT video_id, 0 AS step, list_append(list("start" ORDER BY "start"), max("end") + 1) AS b FROM shots GROUP BY 1 UNION ALL
  SELECT video_id, step + 1, list_concat(b[1:d - 1], b[d + 1:]) FROM (SELECT *, CASE WHEN coalesce(n[j - 1], 1000000000000) <= coalesce(n[j + 1], 1000000000000) AND j > 1 OR j = len(n) THEN j ELSE j + 1 END AS d
    FROM (SELECT *, list_position(n, list_min(n)) AS j FROM (SELECT *, list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i]) AS n FROM st WHERE len(b) > 2)) WHERE list_min(n) < {least})),
fin AS (SELECT video_id, arg_max(b, step) AS b FROM st GROUP BY 1)
SELECT video_id, unnest(b[1:len(b) - 1]) AS "start", unnest(b[2:]) - 1 AS "end" FROM fin"""


def average_linkage(vectors: str, least: float) -> str:
    """un. The mean cosine of two groups is the product of their sums over that of their sizes."""
    pairs = "list_transform(range(1, len(p)), lambda a: list_max(list_transform(range(a + 1, len(p) + 1), lambda b: {s})))"
    sim = f"""{dot("p[a].v", "p[b].v")} / (len(p[a].m) * len(p[b].m))"""
    return f"""WITH RECURSIVE {vectors}, st AS (SELECT video_id, 0 AS step, list(struct_pack(m := [shot_id], v := u) ORDER BY shot_id) AS p FROM un GROUP BY 1 UNION ALL
  SELECT video_id, step + 1, list_concat(p[1:a - 1], [struct_pack(m := list_concat(p[a].m, p[b].m), v := list_transform({DIMS}, lambda i: p[a].v[i] + p[b].v[i]))], p[a + 1:b - 1], p[b + 1:])
  FROM (SELECT video_id, step, p, a, a + list_position(row, list_max(row)) AS b
    FROM (SELECT video_id, step, p, a, list_transform(range(a + 1, len(p) + 1), lambda b: {sim}) AS row
      FROM (SELECT *, list_position(tops, list_max(tops)) AS a FROM (SELECT *, {pairs.format(s=sim)} AS tops FROM st WHERE len(p) > 1)) WHERE list_max(tops) >= {least}))),
fin AS (SELECT video_id, arg_max(p, step) AS p FROM st GROUP BY 1),
gr AS (SELECT video_id, unnest(range(len(p))) AS cluster, unnest(p) AS x FROM fin)
SELECT video_id, unnest(x.m) AS shot_id, cluster FROM gr"""


def density_frames(vectors: str, size: int, eps: float, least: int, most: int) -> str:
    """un; scenes of `size` vectors."""
    return f"""WITH RECURSIVE {vectors}, g AS (SELECT video_id, shot_id // {size} AS scene, shot_id AS frame, u, row_number() OVER w AS rn, count(*) OVER (PARTITION BY video_id, shot_id // {size}) AS n
  FROM un WINDOW w AS (PARTITION BY video_id, shot_id // {size} ORDER BY shot_id)),
pr AS (SELECT a.video_id, a.scene, a.frame AS a, b.frame AS b, {dot("a.u", "b.u")} AS sim FROM g a JOIN g b ON b.video_id = a.video_id AND b.scene = a.scene WHERE a.n > 6),
nr AS (SELECT video_id, scene, a, b FROM pr WHERE sqrt(greatest(0, 2 - 2 * sim)) <= {eps}),
rc AS (SELECT video_id, scene, a, b FROM nr UNION SELECT r.video_id, r.scene, r.a, n.b FROM rc r JOIN nr n ON n.video_id = r.video_id AND n.scene = r.scene AND n.a = r.b),
lb AS (SELECT video_id, scene, a AS frame, least(a, min(b)) AS label FROM rc GROUP BY 1, 2, 3),
gr AS (SELECT video_id, scene, label, count(*) AS k FROM lb GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene ORDER BY k DESC, label) AS r, count(*) OVER (PARTITION BY video_id, scene) AS n_groups FROM gr),
own AS (SELECT lb.video_id, lb.scene, lb.frame, rk.label, rk.n_groups, g.u FROM rk JOIN lb USING (video_id, scene, label) JOIN g ON g.video_id = lb.video_id AND g.frame = lb.frame WHERE r <= {most}),
dm AS (SELECT video_id, scene, label, i, avg(u[i]) AS m FROM own, {DIMS} AS x(i) GROUP BY 1, 2, 3, 4), ml AS (SELECT video_id, scene, label, list(m ORDER BY i) AS m FROM dm GROUP BY 1, 2, 3),
ce AS (SELECT video_id, scene, label, {unit("m")} AS c FROM ml),
best AS (SELECT video_id, scene, arg_max(frame, struct_pack(s := round({dot("u", "c")}, 9), f := -frame)) AS frame, any_value(n_groups) AS n_groups FROM own JOIN ce USING (video_id, scene, label) GROUP BY video_id, scene, label),
few AS (SELECT video_id, scene, a AS frame, round(avg(1 - sim), 9) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY video_id, scene, a ORDER BY 1 - sim) AS r FROM pr) WHERE r <= 5 GROUP BY 1, 2, 3)
SELECT video_id, scene AS scene_id, frame, n_groups FROM best
UNION ALL SELECT video_id, scene, arg_min(frame, struct_pack(c := cost, f := frame)), 1 FROM few WHERE (video_id, scene) NOT IN (SELECT (video_id, scene) FROM gr) GROUP BY 1, 2
UNION ALL SELECT video_id, scene, frame, 1 FROM g WHERE n <= 6 AND CASE WHEN n <= 2 THEN rn IN (1, n) ELSE rn = n // 2 + 1 END"""


def absorb_fragments(tables: str, members: str, short: str, enough: str, similar: str) -> str:
    """members (video_id, shot_id, scene_id, start, end, and v, a vector or words): a change for each step, which joins the
    pieces lo to hi. short: below how many frames pieces p are short; enough: of so many frames a run of short ones stands
    for itself; similar: of pieces x and y."""
    at = lambda i, j: similar.replace("{x}", f"p[{i}]").replace("{y}", f"p[{j}]")
    run = "struct_pack(v := {run}, n := list_sum(list_transform(p[a:b], lambda q: q.n)))"
    vector = similar is MEAN_COSINE
    joined = (lambda lo, hi: f"list_transform({DIMS}, lambda i: list_sum(list_transform(p[{lo}:{hi}], lambda q: q.v[i])))") if vector else (lambda lo, hi: f"list_distinct(flatten(list_transform(p[{lo}:{hi}], lambda q: q.v)))")
    with_run = similar.replace("{x}", "m").replace("{y}", "p[{k}]")
    return f"""WITH RECURSIVE {tables}, od AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id, shot_id) AS rn FROM {members}),
{_scenes(vector)},
st AS (SELECT video_id, 0 AS step, list(struct_pack(f := f, l := l, s := s, e := e, v := v, n := n) ORDER BY f) AS p FROM sn GROUP BY 1 UNION ALL
  SELECT video_id, step + 1, list_concat(p[1:lo - 1], [struct_pack(f := p[lo].f, l := p[hi].l, s := p[lo].s, e := p[hi].e, v := {joined("lo", "hi")}, n := list_sum(list_transform(p[lo:hi], lambda q: q.n)))], p[hi + 1:])
  FROM (SELECT video_id, step, p, CASE
      WHEN a = b THEN CASE WHEN hl AND (lt >= rt OR NOT hr) THEN a - 1 WHEN hr THEN a END
      WHEN same IS NOT NULL THEN CASE WHEN hl AND lt >= 1 THEN a - 1 WHEN hr AND rt >= 1 THEN b ELSE same END
      WHEN whole THEN CASE WHEN hl AND ml >= mr THEN a - 1 ELSE a END
      WHEN hl AND (lt >= rt OR NOT hr) THEN a - 1 WHEN hr THEN b END AS lo, CASE
      WHEN a = b THEN CASE WHEN hl AND (lt >= rt OR NOT hr) THEN a WHEN hr THEN a + 1 END
      WHEN same IS NOT NULL THEN CASE WHEN hl AND lt >= 1 THEN a WHEN hr AND rt >= 1 THEN b + 1 ELSE same + 1 END
      WHEN whole THEN CASE WHEN hl AND ml >= mr THEN b WHEN hr AND mr > ml THEN b + 1 ELSE b END
      WHEN hl AND (lt >= rt OR NOT hr) THEN a WHEN hr THEN b + 1 END AS hi
    FROM (SELECT *, CASE WHEN hl THEN {at("a - 1", "a")} ELSE 0 END AS lt, CASE WHEN hr THEN {at("b", "b + 1")} ELSE 0 END AS rt,
        CASE WHEN hl THEN {with_run.replace("{k}", "a - 1")} ELSE 0 END AS ml, CASE WHEN hr THEN {with_run.replace("{k}", "b + 1")} ELSE 0 END AS mr,
        list_sum(list_transform(p[a:b], lambda q: q.e - q.s + 1)) >= {enough} AS whole,
        CASE WHEN list_max(list_transform(range(CASE WHEN hl THEN a - 1 ELSE a END, CASE WHEN hr THEN b + 1 ELSE b END), lambda k: {at("k", "k + 1")})) >= 1
          THEN coalesce(list_filter(range(a, b), lambda k: {at("k", "k + 1")} >= 1)[1], 0) END AS same
      FROM (SELECT *, a > 1 AS hl, b < len(p) AS hr, {run.replace("{run}", joined("a", "b"))} AS m
        FROM (SELECT *, coalesce(a + list_position(small[a:], false) - 2, len(p)) AS b
          FROM (SELECT *, list_position(small, true) AS a FROM (SELECT video_id, step, p, list_transform(p, lambda q: q.e - q.s + 1 < {short}) AS small FROM st WHERE len(p) > 1 AND step < 100)) WHERE a IS NOT NULL)) r0))
  WHERE lo IS NOT NULL),
fin AS (SELECT video_id, arg_max(p, step) AS p FROM st GROUP BY 1), gr AS (SELECT video_id, unnest(range(len(p))) AS scene_id, unnest(p) AS x FROM fin)
SELECT gr.video_id, gr.scene_id, list(od.shot_id ORDER BY od.rn) AS shot_ids, any_value(x.s) AS "start", any_value(x.e) AS "end" FROM gr JOIN od ON od.video_id = gr.video_id AND od.rn BETWEEN x.f AND x.l GROUP BY 1, 2"""


def _scenes(vector: bool) -> str:
    """Tables up to sn: the scenes of od as pieces."""
    plain = "SELECT video_id, scene_id, min(rn) AS f, max(rn) AS l, min(\"start\") AS s, max(\"end\") AS e, count(*) AS n"
    if not vector:
        return f"sn AS ({plain}, list_distinct(flatten(list(v))) AS v FROM od GROUP BY 1, 2)"
    return f"""sd AS (SELECT video_id, scene_id, i, sum(v[i]) AS x FROM od, {DIMS} AS r(i) GROUP BY 1, 2, 3), sw AS (SELECT video_id, scene_id, list(x ORDER BY i) AS v FROM sd GROUP BY 1, 2),
sn AS ({plain}, any_value(sw.v) AS v FROM od JOIN sw USING (video_id, scene_id) GROUP BY 1, 2)"""


#: Mean cosine of the vectors of two pieces, and the overlap coefficient of their words.
MEAN_COSINE = f"""({dot("{x}.v", "{y}.v")} / ({{x}}.n * {{y}}.n))"""
COMMON_WORDS = "CASE WHEN len({x}.v) = 0 OR len({y}.v) = 0 THEN 0.0 ELSE len(list_intersect({x}.v, {y}.v)) / least(len({x}.v), len({y}.v)) END"


def key_frames(frames: str, kernel: str, size: int, least: int, most: int, radius: int) -> str:
    """Tables up to ft (video_id, shot_id, start, end, fallback): the first `most` stable runs of each shot of `size` frames,
    and kf, the frames with sharpness and brightness."""
    return f"""{frames}, kernel(o, w) AS (VALUES {kernel}),
kf AS (SELECT video_id, frame // {size} AS shot_id, frame, frame % {size} AS i, score, k / 100 AS sharp, k % 10 / 10 AS bright, count(*) OVER (PARTITION BY video_id, frame // {size}) AS n FROM fr),
ix AS (SELECT video_id, shot_id, frame, w, n, CAST(((i + o) % (2 * n) + 2 * n) % (2 * n) AS BIGINT) AS m FROM kf, kernel),
sm AS (SELECT x.video_id, x.shot_id, x.frame, round(sum(x.w * f.score), 6) AS smooth FROM ix x JOIN kf f ON f.video_id = x.video_id AND f.shot_id = x.shot_id AND f.i = CASE WHEN m >= x.n THEN 2 * x.n - 1 - m ELSE m END GROUP BY 1, 2, 3),
lv AS (SELECT video_id, shot_id, quantile_cont(smooth, 0.35) AS lv, arg_min(frame, struct_pack(s := smooth, f := frame)) AS low, min(frame) AS a, max(frame) AS b FROM sm GROUP BY 1, 2),
fl AS (SELECT sm.*, frame - row_number() OVER (PARTITION BY sm.video_id, sm.shot_id ORDER BY frame) AS island FROM sm JOIN lv USING (video_id, shot_id) WHERE smooth < lv),
rn AS (SELECT video_id, shot_id, min(frame) AS "start", max(frame) AS "end", false AS fallback FROM fl GROUP BY video_id, shot_id, island HAVING count(*) >= {least}),
al AS (SELECT * FROM rn UNION ALL SELECT video_id, shot_id, greatest(low - {max(least // 2, 1)}, a), least(low + {max(least // 2, 1)}, b), true FROM lv WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.video_id = lv.video_id AND rn.shot_id = lv.shot_id)),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY "start") AS r FROM al) WHERE r <= {most}),
lo AS (SELECT ft.video_id, ft.shot_id, "start", "end", arg_min(frame, struct_pack(s := score, f := frame)) AS mid FROM ft JOIN kf ON kf.video_id = ft.video_id AND kf.shot_id = ft.shot_id AND frame BETWEEN "start" AND "end" GROUP BY 1, 2, 3, 4),
tp AS (SELECT lo.*, frame, score, sharp, bright, max(score) OVER p AS m, max(sharp) OVER p AS s, count(*) OVER p AS n FROM lo JOIN kf ON kf.video_id = lo.video_id AND kf.shot_id = lo.shot_id
  AND frame BETWEEN greatest(mid - {radius}, "start") AND least(mid + {radius}, "end") WINDOW p AS (PARTITION BY lo.video_id, lo.shot_id, "start")),
vl AS (SELECT *, CASE WHEN n = 1 THEN 0.0 ELSE 0.5 * (1 - score / (m + 1e-6)) + 0.3 * (sharp / (s + 1e-6)) + 0.2 * greatest(0.0, least(1.0, 1 - 3 * abs(bright - 0.5))) END AS value FROM tp)"""
