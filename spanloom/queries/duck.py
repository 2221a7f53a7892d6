"""The adapter views as DuckDB SQL, to check the Spark queries with."""

from __future__ import annotations

VIEWS = {
    "v_frames": "select vec_id // 50 as video_id, vec_id % 50 as i, (vec_id % 50) / 2.0::double as ts, embedding::double[] as emb, label as class_idx from embeddings",
    "v_sec": "select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double as sec from events",
    "v_curve": "select user_id as video_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, sec, event_type as class_name, value / (value + 35.0::double) as p from v_sec",
    "v_video": "select distinct user_id as video_id, 1 + user_id % 3 as level, user_id % 6 <> 0 as is_anomaly from events",
    "v_gt": "select user_id as video_id, event_id as gt_id, event_type as class_name, sec as st, sec + (4 + event_id % 9) * 3600.0::double as en from v_sec where user_id % 6 <> 0",
    "v_pred": """select user_id as video_id, event_id as pred_id, case when event_id % 11 = 0 then 'click' else event_type end as class_name,
      sec + ((event_id * 37) % 13 - 6) * 900.0::double as st,
      sec + ((event_id * 37) % 13 - 6) * 900.0::double + (4 + event_id % 9) * 3600.0::double * (0.6::double + 0.1::double * (event_id % 9)) as en,
      value / (value + 35.0::double) as score from v_sec where event_id % 5 <> 0""",
    "v_head": """select class_idx, list(m order by d) as w from (select class_idx, d, avg(emb[d]) as m from (select class_idx, emb, unnest(range(1, len(emb) + 1)) as d from v_frames) group by 1, 2) group by 1""",
    "v_cand": """select p.video_id, p.class_name, p.pred_id, g.gt_id, (least(p.en, g.en) - greatest(p.st, g.st)) / (greatest(p.en, g.en) - least(p.st, g.st)) as iou
      from v_pred p join v_gt g on p.video_id = g.video_id and p.class_name = g.class_name and p.st < g.en and g.st < p.en
      where (least(p.en, g.en) - greatest(p.st, g.st)) / (greatest(p.en, g.en) - least(p.st, g.st)) >= 0.5""",
    "v_rank": "select *, row_number() over (partition by video_id, class_name order by iou desc, pred_id, gt_id) as rn from v_cand",
    "v_fold": """select video_id, class_name, pred_id, gt_id, iou, rn, true as taken, [pred_id] as ps, [gt_id] as gs from v_rank where rn = 1
      union all
      select c.video_id, c.class_name, c.pred_id, c.gt_id, c.iou, c.rn, not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id),
        case when not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id) then list_append(f.ps, c.pred_id) else f.ps end,
        case when not list_contains(f.ps, c.pred_id) and not list_contains(f.gs, c.gt_id) then list_append(f.gs, c.gt_id) else f.gs end
      from v_fold f join v_rank c on c.video_id = f.video_id and c.class_name = f.class_name and c.rn = f.rn + 1""",
    "v_match": "select video_id, class_name, pred_id, gt_id, iou from v_fold where taken",
    "v_comp": """select v.video_id, v.level, v.is_anomaly, coalesce(p.n, 0) as n_pred, coalesce(g.n, 0) as n_gt, coalesce(m.n, 0) as matched,
        case when coalesce(p.n, 0) + coalesce(g.n, 0) > 0 then 2.0::double * coalesce(m.n, 0) / (coalesce(p.n, 0) + coalesce(g.n, 0)) else 0 end as f1,
        case when coalesce(m.n, 0) > 0 then m.s / m.n else 0 end as mean_iou
      from v_video v left join (select video_id, count(*) as n from v_pred group by 1) p using (video_id)
      left join (select video_id, count(*) as n from v_gt group by 1) g using (video_id)
      left join (select video_id, count(*) as n, sum(iou) as s from v_match group by 1) m using (video_id)""",
    "v_weights": """select * from (values ('L2', 0, 0.2::double, 0.5::double, 0.3::double), ('L2', 1, 0.3, 0.4, 0.3), ('L2', 2, 0.34, 0.33, 0.33),
      ('L3', 0, 0.2, 0.4, 0.4), ('L3', 1, 0.2, 0.3, 0.5), ('L3', 2, 0.3, 0.3, 0.4)) as t(level_name, w_id, w_alert, w_match, w_time)""",
    "v_level": """select w.level_name, w.w_id, coalesce(avg(case when c.n_gt = 0 then (c.n_pred = 0)::int::double else w.w_alert * (c.n_pred > 0)::int + w.w_match * c.f1 + w.w_time * c.mean_iou end), 0) as score
      from v_weights w left join v_comp c on c.level = substr(w.level_name, 2)::int group by 1, 2""",
    "v_l1": """select coalesce(avg(((guess <> 'normal') = is_anomaly)::int::double), 0) as binary_acc, coalesce(avg((guess = truth)::int::double), 0) as class_acc from (
        select v.is_anomaly, coalesce(p.c, 'normal') as guess, case when v.is_anomaly then coalesce(g.c, 'normal') else 'normal' end as truth from v_video v
        left join (select video_id, arg_min(class_name, rk) as c from (select *, row_number() over (partition by video_id order by score desc, pred_id) as rk from v_pred) group by 1) p using (video_id)
        left join (select video_id, arg_min(class_name, gt_id) as c from v_gt group by 1) g using (video_id) where v.level = 1)""",
    "v_grid": """select a.w_id as w2, b.w_id as w3, 25 * (l.binary_acc + l.class_acc) / 2 as d1, 35 * a.score as d2, 40 * b.score as d3
      from (select * from v_level where level_name = 'L2') a, (select * from v_level where level_name = 'L3') b, v_l1 l""",
    "v_dist": "select video_id, i, class_idx, 1 - list_dot_product(emb, nxt) / (greatest(sqrt(list_dot_product(emb, emb)), 1e-8) * greatest(sqrt(list_dot_product(nxt, nxt)), 1e-8)) as d from (select *, lead(emb) over (partition by video_id order by i) as nxt from v_frames) where nxt is not null",
    "v_peak": """select * from (select *, lag(d) over w as b, lead(d) over w as a from v_dist window w as (partition by video_id order by i)) where d >= b and d >= a""",
    "v_cp": "select video_id, i as cp from (select *, row_number() over (partition by video_id order by b desc, i desc) as k from v_peak) where k <= 8",
    "v_spans": "select video_id, 5 + video_id % 7 as st, 30 + video_id % 11 as en, 50 as n from (select distinct video_id from v_frames)",
    "v_n": "select video_id, count(*) as n from v_curve group by 1",
    "v_windows": "select video_id, n, st, least(n, st + 6) as en from (select *, unnest(list_distinct(list_concat(range(0, greatest(0, n - 6) + 1, 2), [greatest(0, n - 6)]))) as st from v_n)",
    "v_win": "select video_id, n, st, en, (array_agg(class_name order by p desc, i))[1] as cls, max(p) as score from v_windows join v_curve using (video_id) where i >= st and i < en group by all",
    "v_wcand": "select * from v_win where score >= 0.65",
    "v_merged": """select video_id, n, grp, min(st) as st, max(en) as en, arg_min(cls, st) as cls, max(score) as score from (
        select *, sum(nw) over (partition by video_id order by st, en) as grp from (select *, case when st <= lag(en) over w + 2 and cls = lag(cls) over w then 0 else 1 end as nw from v_wcand window w as (partition by video_id order by st, en))) group by 1, 2, 3""",
    "v_desmear": """select video_id, n, grp, cls, score, case when e - s < 2 then round_even((s + e) / 2.0::double - 1, 0)::bigint else s end as st, case when e - s < 2 then round_even((s + e) / 2.0::double + 1, 0)::bigint else e end as en
      from (select *, round_even(st + 3.0::double, 0)::bigint as s, round_even(en - 3.0::double, 0)::bigint as e from v_merged)""",
    "v_expand": """select video_id, n, grp, cls, score, greatest(0, floor((st + en) / 2.0::double - greatest(1.0::double, (en - st) * 1.25::double / 2)))::bigint as st, least(n, ceil((st + en) / 2.0::double + greatest(1.0::double, (en - st) * 1.25::double / 2)))::bigint as en from v_desmear""",
}

#: What each view reads of the others.
_NEEDS = {v: [w for w in VIEWS if w != v and w in sql.replace("(", " ").replace(")", " ").replace(",", " ").split()] for v, sql in VIEWS.items()}


def duck(sql: str) -> str:
    """sql with the views that it reads put before it."""
    order: list[str] = []

    def visit(view: str) -> None:
        if view not in order:
            for other in _NEEDS[view]:
                visit(other)
            order.append(view)

    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    for view in VIEWS:
        if view in words:
            visit(view)
    if not order:
        return sql
    recursive = "recursive " if "v_fold" in order or sql.startswith("with recursive ") else ""
    own = sql.removeprefix("with ").removeprefix("recursive ")
    return f"with {recursive}" + ",\n".join(f"{v} as ({VIEWS[v]})" for v in order) + (f",\n{own}" if own != sql else f"\n{sql}")
