"""Check SQL of the fusion forest: grown and asked again, one common table per level."""

from idsignal.operators import forest, fusion

CLASSES = range(forest.CLASSES)
PLACES = range(len(fusion.INPUTS))
COUNTS = ", ".join(forest.COUNTS)
SUMS = ", ".join(f"sum({n})::bigint as {n}" for n in forest.COUNTS)
BINS = ", ".join(f"b{i}" for i in PLACES)


def draw(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(keys)})), 1, {forest.DRAW_DIGITS}))::bigint / {16 ** forest.DRAW_DIGITS}.0::double)"


def squares(names: list[str]) -> str:
    return f"(({' + '.join(f'{n} * {n}' for n in names)})::double / ({' + '.join(names)})::double)"


def grown_sql(scaled: str, trees: int, depth: int) -> str:
    """Tables up to `alerts` (id, s0.., label, predicted): summed class shares, from the table `scaled` (id, f0.., label)."""
    weight = " + ".join(f"(drawn >= {edge!r}::double)::int" for edge in forest.POISSON)
    bins = ", ".join(f"coalesce(least({forest.BINS - 1}, greatest(0, floor(f{i} * {forest.BINS})::int)), 0) as b{i}" for i in PLACES)
    placed = ", ".join(f"sum(case when label = {c} then weight else 0 end)::bigint as n{c}" for c in CLASSES)
    left, right, total = ([f"{side}{c}" for c in CLASSES] for side in ("l", "r", "t"))
    seed = str(forest.SEED)
    parts = [f"""
cells as materialized (select id, label, {bins} from {scaled}),
learned as (select * from cells where {draw('id', str(fusion.SEED), "'test'")} >= {1 / fusion.TEST_PARTS!r}),
chosen as (select * from learned where {draw('id', str(fusion.SEED), "'fit'")} * (select count(*) from learned) < {fusion.TRAIN_ROWS}),
weighed as (select *, {weight} as weight from (
  select *, {draw(seed, 'id', 'tree')} as drawn from chosen cross join range(1, {trees + 1}) t(tree))),
at0 as materialized (select tree, 1 as node, {BINS}, {placed} from weighed where weight > 0 group by tree, {BINS})"""]
    for level in range(depth):
        feature = "case input " + " ".join(f"when {i} then b{i}" for i in PLACES) + " end"
        parts.append(f"""
tried{level} as (
  select tree, node, input from (
    select *, row_number() over (partition by tree, node order by {draw(seed, 'tree', 'node', 'input')}, input) as place
    from (select distinct tree, node from at{level} where node >= {1 << level}) cross join range({len(PLACES)}) i(input))
  where place <= {forest.TRIED}),
hist{level} as (
  select a.tree, a.node, input, {feature} as bin, {SUMS} from at{level} a join tried{level} t on a.tree = t.tree and a.node = t.node
  group by a.tree, a.node, input, bin),
summed{level} as (
  select tree, node, input, bin, {', '.join(f'sum(n{c}) over below as l{c}, sum(n{c}) over whole as t{c}' for c in CLASSES)} from hist{level}
  window whole as (partition by tree, node, input), below as (partition by tree, node, input order by bin rows unbounded preceding)),
sides{level} as (
  select tree, node, input, bin, {', '.join(f'l{c}::bigint as l{c}, (t{c} - l{c})::bigint as r{c}, t{c}::bigint as t{c}' for c in CLASSES)} from summed{level}),
split{level} as materialized (
  select tree, node, input, bin from (
    select *, row_number() over (partition by tree, node order by score desc, input, bin) as place
    from (select *, {squares(left)} + {squares(right)} as score from sides{level} where {' + '.join(right)} > 0)
    where score > {squares(total)} + {forest.LEAST_GAIN!r}::double)
  where place = 1),
at{level + 1} as materialized (
  select a.tree, case when input is null then a.node else 2 * a.node + ({feature} > bin)::int end as node, {BINS}, {COUNTS}
  from at{level} a left join split{level} s on a.tree = s.tree and a.node = s.node)""")
        asked = f"walk{level}" if level else f"(select distinct {BINS}, tree, 1 as node from cells cross join range(1, {trees + 1}) t(tree))"
        parts.append(f"""
walk{level + 1} as materialized (
  select {BINS}, w.tree, case when input is null then w.node else 2 * w.node + ({feature} > bin)::int end as node
  from {asked} w left join split{level} s on w.tree = s.tree and w.node = s.node)""")
    size = " + ".join(forest.COUNTS)
    parts.append(f"""
leaves as (select tree, node, {SUMS} from at{depth} group by tree, node),
shares as (
  select {BINS}, {', '.join(f'coalesce(sum(n{c} * {forest.SHARE_UNITS} // ({size})), 0)::bigint as s{c}' for c in CLASSES)}
  from walk{depth} w left join leaves l on l.tree = w.tree and l.node = w.node group by {BINS}),
alerts as (
  select c.id, c.label, {', '.join(f's{c}' for c in CLASSES)}, list_position([{', '.join(f's{c}' for c in CLASSES)}],
    greatest({', '.join(f's{c}' for c in CLASSES)})) - 1 as predicted
  from cells c join shares s on {' and '.join(f'c.b{i} = s.b{i}' for i in PLACES)})""")
    return ",".join(parts)
