"""Similarity join of ordered sets by prefix trees.

Sets hold 64-bit tokens in one global order, rare ones first. Two sets link when link[1] * intersection >= link[0] * union,
and then share a token among their leading ones. Where few sets share such a token, their pairs are counted and compared if
they share enough; where many do, the sets meet in one place, each sent once. There the tokens that they share are listed where
they are few for the sets, and else the sets walk a tree of the sets there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.shared import components, forget, release, small, stored

Link = tuple[int, int]
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of sets in one tree, and of probes that walk it together; larger groups are dealt over several blocks.
BLOCK_BYTES = 8 << 20
#: Sets at a token up to which their pairs are listed (each set is then in as many rows at most); more meet in one place.
FEW = 24
#: Shared tokens of a block, for each of its sets, up to which they are listed (beyond it the sets walk a tree), and how many of
#: them are held at a time.
LISTED, HELD = 2_000, 1 << 20


def prefix_length(size: np.ndarray, link: Link) -> np.ndarray:
    """Leading tokens among which two linked sets must share one."""
    return size - -(-size * link[0] // link[1]) + 1


def leading_of(sets: DataFrame, link: Link) -> DataFrame:
    """token, sid, place of the leading tokens of sets (sid, tokens in the global order): place holds the set's size above the
    token's position in it, 32 bits each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
            size = np.array([len(x) for x in tokens], np.int64)
            take = np.minimum(prefix_length(size, link), size)
            own = np.repeat(np.arange(len(size)), take)
            position = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            flat = np.concatenate([x[:n] for x, n in zip(tokens, take.tolist(), strict=True)]) if tokens else np.zeros(0, np.int64)
            yield pa.record_batch({"token": pa.array(flat), "sid": part.column("sid").take(pa.array(own)), "place": pa.array(size[own] << 32 | position)})

    return sets.select("sid", "tokens").mapInArrow(run, "token long, sid long, place long")


def _by_token(parts: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Arrays of whole token groups from rows sorted by token (a group may span batches); groups of one row are dropped."""
    held: list[np.ndarray] | None = None
    for part in parts:
        now = [part.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # tokens ascend
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None and len(held[0]):
        yield held


def _sizes_fit(a: np.ndarray, b: np.ndarray, link: Link) -> np.ndarray:
    low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    return link[1] * low >= link[0] * high


def overlap_needed(m, p, link: Link):
    """Tokens that linked sets of these sizes share at least."""
    return -(-link[0] * (m + p) // (link[0] + link[1]))


def behind(size, link: Link):
    """Tokens of a set that are not among its leading ones."""
    return -(-size * link[0] // link[1]) - 1


def shared_needed(m, p, link: Link):
    """How many of their leading tokens linked sets share, at least: of the two last leading tokens the earlier one has no more
    behind it than one of the sets has, and what follows cannot make up for more."""
    return np.maximum(1, overlap_needed(m, p, link) - np.maximum(behind(m, link), behind(p, link)))


def may_link(shared, at, to, m, p, link: Link):
    """Whether sets of m and p tokens may link that share so many leading tokens, the last of them at these positions. The leading
    tokens that two sets share are their first shared ones, so all before the last that are not shared count against the overlap."""
    need = overlap_needed(m, p, link)
    return (shared >= shared_needed(m, p, link)) & (at - shared + 1 <= m - need) & (to - shared + 1 <= p - need)


def _few_pairs(link: Link) -> Batches:
    """Pairs of different components at each token, from rows sorted by token; no token has more than FEW sets. at and to are the
    token's positions in both, m and p their sizes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, sid, place, comp in _by_token(parts, ("token", "sid", "place", "comp")):
            size, position = place >> 32, (place & 0xFFFFFFFF).astype(np.int32)
            found = []
            for step in range(1, FEW):  # the set that stands so many places further
                if step >= len(token):
                    break
                x, y = np.arange(len(token) - step), np.arange(step, len(token))
                good = np.flatnonzero((token[x] == token[y]) & (comp[x] != comp[y]) & _sizes_fit(size[x], size[y], link))
                found.append((good, good + step))
            if not found:
                continue
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            if len(x):
                low = sid[x] < sid[y]
                x, y = np.where(low, y, x), np.where(low, x, y)
                m, p = size[x].astype(np.int32), size[y].astype(np.int32)
                yield pa.record_batch({"member": pa.array(sid[x]), "pivot": pa.array(sid[y]), "at": pa.array(position[x]), "to": pa.array(position[y]), "m": pa.array(m), "p": pa.array(p)})

    return run


class PrefixTree:
    """Sets in the global order, as a tree of token runs; sets with equal leading tokens share their path.

    With sizes and positions the sets are only those leading tokens of sets of these sizes, at these positions, that others have: a
    walk then finds what may link.
    """

    #: Tokens of a run that are taken before probes that cannot reach the overlap needed are let go.
    STRETCH = 64

    def __init__(self, sets: list[np.ndarray], link: Link, sizes: np.ndarray | None = None, positions: list[np.ndarray] | None = None):
        self.sets, self.link, self.sizes, self.positions = sets, link, sizes, positions
        order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
        common = np.zeros(len(order), np.int64)
        for k, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
            x, y = sets[i], sets[j]
            m = min(len(x), len(y))
            differ = x[:m] != y[:m]
            common[k] = int(differ.argmax()) if differ.any() else m
        length = np.array([len(sets[k]) for k in order], np.int64)
        whole = length if sizes is None else sizes[order]
        #: A node: run of tokens, depth after it, longest set below, least and largest size below, sets that end here, children.
        self.root = None
        above: list = []
        todo = [(0, len(order), 0, above)] if order else []
        while todo:
            low, high, depth, siblings = todo.pop()
            end = int(min(length[low], common[low + 1 : high].min(initial=length[low])))
            stop = low + int(np.count_nonzero(length[low:high] == end))  # a set that ends here stands before those that go on
            children: list = []
            below = whole[low:high]
            siblings.append((sets[order[low]][depth:end], end, int(length[low:high].max()), int(below.min()), int(below.max()), order[low:stop], children))
            cuts = [stop, *(stop + 1 + np.flatnonzero(common[stop + 1 : high] <= end)).tolist(), high] if stop < high else []
            todo += [(x, y, end, children) for x, y in zip(cuts, cuts[1:], strict=False)]
        if above:
            self.root = above[0]

    def walk(self, probes: list[np.ndarray], sizes: np.ndarray | None = None, positions: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each set that probes link (or may link) with, and the numbers of those probes; the probes walk together."""
        if self.root is None or not probes:
            return
        t, u = self.link
        length = np.array([len(p) for p in probes], np.int64)
        size = length if sizes is None else sizes
        whole = np.concatenate(probes)
        order = np.argsort(whole)
        owner = np.repeat(np.arange(len(probes)), length)[order]
        place = np.concatenate(positions)[order] if positions is not None else None
        tokens, start = np.unique(whole[order], return_index=True)
        count = np.diff(np.append(start, len(whole)))
        alive = np.flatnonzero(length)

        def postings(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Which tokens of the piece probes have, how many each, and where in owner and place."""
            at = np.searchsorted(tokens, piece)
            at[at == len(tokens)] = 0
            has = np.flatnonzero(tokens[at] == piece)
            at = at[has]
            n = count[at]
            return has, n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[at], n)

        def plausible(k: int, found: np.ndarray, shared: np.ndarray) -> np.ndarray:
            has, n, flat = postings(self.sets[k])
            last, own_last = np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
            np.maximum.at(last, owner[flat], place[flat])
            np.maximum.at(own_last, owner[flat], np.repeat(self.positions[k][has], n))
            return found[may_link(shared, last[found], own_last[found], size[found], self.sizes[k], self.link)]

        stack = [(self.root, np.zeros(len(alive), np.int64), alive)]
        while stack and len(tokens):
            (run, depth, longest, least, most, ended, children), overlap, alive = stack.pop()
            for first in range(0, len(run), self.STRETCH):
                piece = run[first : first + self.STRETCH]
                _, _, flat = postings(piece)
                if len(flat):
                    overlap = overlap + np.bincount(owner[flat], minlength=len(probes))[alive]
                left = longest - (depth - len(run) + first + len(piece))
                if self.sizes is None:  # overlap needed: t * (size + most) / (t + u), and at most what is left can be added
                    good = (t + u) * (overlap + left) >= t * (size[alive] + most)
                else:
                    good = overlap + left + np.maximum(behind(size[alive], self.link), behind(most, self.link)) >= overlap_needed(size[alive], least, self.link)
                if not good.all():
                    overlap, alive = overlap[good], alive[good]
                    if not len(alive):
                        break
            if not len(alive):
                continue
            if self.sizes is None and ended:
                linked = alive[u * overlap >= t * (size[alive] + depth - overlap)]
                for k in ended if len(linked) else ():
                    yield k, linked
            elif ended:
                for k in ended:
                    own = self.sizes[k]
                    enough = (overlap >= shared_needed(size[alive], own, self.link)) & _sizes_fit(size[alive], own, self.link)
                    linked = plausible(k, alive[enough], overlap[enough]) if enough.any() else alive[:0]
                    if len(linked):
                        yield k, linked
            stack += [(c, overlap, alive) for c in children]


def _common(own: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]] | None:
    """Numbers of both sets, and places in the concatenated own and others, of each token that sets of both share: a slice of own at
    a time. None where the sets share too many tokens to list them."""
    a, b = np.concatenate(own), np.concatenate(others)
    order = np.argsort(b)
    b = b[order]
    low = np.searchsorted(b, a)
    n = np.searchsorted(b, a, "right") - low
    of_a = np.repeat(np.arange(len(own)), [len(x) for x in own])
    of_b = np.repeat(np.arange(len(others)), [len(x) for x in others])
    each = np.bincount(of_a, n, len(own)).astype(np.int64)
    if each.sum() > LISTED * (len(own) + len(others)) or each.max() > HELD:
        return None
    ends = np.cumsum(np.bincount(of_a, minlength=len(own)))

    def slices():
        first, total = 0, np.cumsum(each)
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HELD, "right")))
            x = np.arange(ends[first - 1] if first else 0, ends[last - 1])
            count = n[x]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low[x], count)
            x, y = np.repeat(x, count), order[at]
            if len(x):
                yield of_a[x], of_b[y], x, y
            first = last

    return slices()


def _by_own(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in i (ascending) with its numbers in j."""
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else ()
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield int(i[low]), j[low:high]


def _links(own: list[np.ndarray], others: list[np.ndarray], link: Link) -> Iterator[tuple[int, np.ndarray]]:
    """Own sets that others link with, and the numbers of those."""
    common = _common(own, others)
    if common is None:
        yield from PrefixTree(own, link).walk(others)
        return
    m, p = (np.array([len(x) for x in y], np.int64) for y in (own, others))
    for i, j, _, _ in common:
        key, shared = np.unique(i * len(others) + j, return_counts=True)
        i, j = np.divmod(key, len(others))
        good = link[1] * shared >= link[0] * (m[i] + p[j] - shared)
        yield from _by_own(i[good], j[good])


def _possible(own: list[np.ndarray], others: list[np.ndarray], sizes: list[np.ndarray], positions: list[list[np.ndarray]], link: Link) -> Iterator[tuple[int, np.ndarray]]:
    """Own sets that others may link with (see may_link), by leading tokens, and the numbers of those."""
    common = _common(own, others)
    if common is None:
        yield from PrefixTree(own, link, sizes[0], positions[0]).walk(others, sizes[1], positions[1])
        return
    to, at = (np.concatenate(x) for x in positions)
    for i, j, x, y in common:
        good = np.flatnonzero(_sizes_fit(sizes[0][i], sizes[1][j], link))
        if not len(good):
            continue
        key = (i * len(others) + j)[good]
        order = np.argsort(key, kind="stable")
        key, good = key[order], good[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        i, j = np.divmod(key[starts], len(others))
        last, own_last = np.maximum.reduceat(at[y[good]], starts), np.maximum.reduceat(to[x[good]], starts)
        may = may_link(np.diff(starts, append=len(key)), last, own_last, sizes[1][j], sizes[0][i], link)
        yield from _by_own(i[may], j[may])


class _Joined:
    """Which of some numbers have been joined; the smaller side moves."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.inside: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        x, y = self.root.get(a, a), self.root.get(b, b)
        if x == y:
            return False
        low, high = sorted((x, y), key=lambda z: len(self.inside.get(z, (z,))))
        moved = self.inside.pop(low, [low])
        self.inside.setdefault(high, [high]).extend(moved)
        self.root.update(dict.fromkeys(moved, high))
        return True


def _blocks(parts: Iterator[pa.RecordBatch]):
    """(owner, r, c), and of its probes and its members sid to (tokens, comp, size, positions), from rows sorted by block."""
    block, probes, members = None, {}, {}
    names = ("owner", "r", "c", "member", "probe", "sid", "comp", "size", "tokens", "positions")
    for part in parts:
        for owner, r, c, member, probe, sid, comp, size, tokens, positions in zip(*(part.column(x).to_pylist() for x in names), strict=True):
            if block != (owner, r, c):
                if probes and members:
                    yield block, probes, members
                block, probes, members = (owner, r, c), {}, {}
            one = (np.frombuffer(tokens, np.uint64), comp, size, np.frombuffer(positions or b"", np.int32))
            if member:
                members[sid] = one  # copies from several tasks fall together
            if probe:
                probes[sid] = one
    if probes and members:
        yield block, probes, members
    release()


def _met_in(probes: dict, members: dict, link: Link) -> Iterator[tuple[int, int, int, int]]:
    """(sid, comp) of both sides of links between probes and members: enough to join what all links join."""
    few, many = sorted((probes, members), key=len)
    a, b = list(few), list(many)
    own, others = list(few.values()), list(many.values())
    of_b = np.array([x[1] for x in others], np.int64)
    joined = _Joined()
    for k, found in _links([x[0] for x in own], [x[0] for x in others], link):
        comp = own[k][1]
        comps, first = np.unique(of_b[found], return_index=True)
        for c, at in zip(comps.tolist(), found[first].tolist(), strict=True):
            if c != comp and joined.join(comp, c):
                yield a[k], comp, b[at], c


def _walk_trees(link: Link) -> Batches:
    """Pairs (a, b) of components that links join, from rows sorted by block. Of a block's links those are given that join
    components not joined there before, so there are fewer than sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        rows = lambda: pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for _, probes, members in _blocks(parts):
            found += [(x, y) for _, x, _, y in _met_in(probes, members, link)]
            if len(found) > 10_000:
                yield rows()
                found.clear()
        if found:
            yield rows()

    return run


def _walk_leading(link: Link) -> Batches:
    """Pairs (a, b) of sets of a block that may link, by their leading tokens: enough to join all that may. Rows are sorted by
    block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, probes, members in _blocks(parts):
            every = members | probes
            few, many = sorted((probes, members), key=len)
            a, b = list(few), list(many)
            own, others = list(few.values()), list(many.values())
            sizes = [np.array([x[2] for x in y], np.int64) for y in (own, others)]
            sids = list(every)
            at = {s: k for k, s in enumerate(sids)}
            at_a, at_b = [at[s] for s in a], np.array([at[s] for s in b])
            comp = np.array([x[1] for x in every.values()], np.int64)
            group = np.arange(len(sids))
            positions = [[x[3] for x in y] for y in (own, others)]
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for k, found in _possible([x[0] for x in own], [x[0] for x in others], sizes, positions, link):
                to = at_b[found]
                to = to[(comp[to] != comp[at_a[k]]) & (group[to] != group[at_a[k]])]
                if len(to):
                    others_of, first = np.unique(group[to], return_index=True)
                    group[np.isin(group, others_of)] = group[at_a[k]]
                    pairs.append((np.full(len(first), at_a[k]), to[first]))
            if pairs:
                x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
                number = np.array(sids, np.int64)
                yield pa.record_batch({"a": pa.array(number[x]), "b": pa.array(number[y])})

    return run


def _dealt(places: DataFrame, sets: DataFrame, name: str, part: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows of _blocks, each with its set, sorted by block; and the stored table of who goes where.

    An owner's probes and members meet in blocks of bounded bytes, so a set is sent once for each block and not for each pair;
    where one block holds all, a set goes there once though it be both. part: the share of a set that sets hold.
    """
    once = places.groupBy("owner", "sid").agg(F.first("comp").alias("comp"), F.first("size").alias("size"), F.max("member").alias("member"), F.max("probe").alias("probe"))
    many = lambda side: F.greatest(F.ceil(8 * part * F.sum(F.when(F.col(side), F.col("size"))) / BLOCK_BYTES), F.lit(1)).cast("int")
    shape = once.groupBy("owner").agg(many("probe").alias("rows"), many("member").alias("columns"))
    here = lambda count: F.pmod(F.xxhash64("sid"), F.col(count)).cast("int")
    spot = lambda r, c, m, p: F.struct(r.alias("r"), c.alias("c"), m.alias("member"), p.alias("probe"))
    every = lambda count, f: F.transform(F.sequence(F.lit(0), F.col(count) - 1), f)
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    none = F.array().cast("array<struct<r:int,c:int,member:boolean,probe:boolean>>")
    apart = F.concat(
        F.when(F.col("member"), every("rows", lambda r: spot(r, here("columns"), yes, no))).otherwise(none),
        F.when(F.col("probe"), every("columns", lambda c: spot(here("rows"), c, no, yes))).otherwise(none),
    )
    spots = F.when((F.col("rows") == 1) & (F.col("columns") == 1), F.array(spot(zero, zero, F.col("member"), F.col("probe")))).otherwise(apart)
    to = stored(once.join(shape, "owner").select("owner", "sid", "comp", "size", F.explode(spots).alias("s")).select("owner", "sid", "comp", "size", "s.*"), name)
    met = sets.join(F.broadcast(to) if small(to) else to, "sid")
    met = met.repartition("owner", "r", "c").sortWithinPartitions("owner", "r", "c")
    positions = F.col("positions") if "positions" in sets.columns else F.lit(None).cast("binary").alias("positions")
    return met.select("owner", "r", "c", "member", "probe", "sid", "comp", "size", "tokens", positions), to


def linked(places: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    """Pairs (a, b) of components that links between an owner's probes and its members join, stored.

    places: owner, sid, comp, size, member, probe; sets: sid and tokens in the global order.
    """
    met, to = _dealt(places, sets, "places")
    out = stored(met.mapInArrow(_walk_trees(link), "a long, b long"), "links")
    forget(to)
    return out


def _one_each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, its tokens and their positions, from rows sorted by sid and token."""
    held = None
    for part in parts:
        now = [part.column(c).to_numpy() for c in ("sid", "token", "at")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        sid, token, at = now
        if not len(sid):
            continue
        starts = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
        held = [x[starts[-1] :] for x in now]
        if len(starts) > 1:
            runs = list(zip(starts, starts[1:], strict=False))
            yield pa.record_batch({"sid": pa.array(sid[starts[:-1]]), "tokens": pa.array([token[a:b].tobytes() for a, b in runs], pa.binary()), "positions": pa.array([at[a:b].tobytes() for a, b in runs], pa.binary())})
    if held is not None:
        yield pa.record_batch({"sid": pa.array(held[0][:1]), "tokens": pa.array([held[1].tobytes()], pa.binary()), "positions": pa.array([held[2].tobytes()], pa.binary())})


def _may_link(link: Link) -> Column:
    """may_link over the columns shared, at, to, m and p."""
    t, u = link
    shared, m, p = F.col("shared"), F.col("m").cast("long"), F.col("p").cast("long")
    need = F.ceil(F.lit(t) * (m + p) / (t + u))
    behind_most = F.ceil(F.lit(t) * F.greatest(m, p) / u) - 1
    return (shared >= need - behind_most) & (F.col("at") - shared + 1 <= m - need) & (F.col("to") - shared + 1 <= p - need)


def places_across(leading: DataFrame, about: DataFrame, link: Link) -> DataFrame:
    """Where sets of different components that may link meet: owner, sid, comp, size, member, probe.

    leading: token, sid, place (the set's size above the token's position, 32 bits each); about (stored): sid, comp, label of the
    sets that are not alone in both. Labels decide nothing but where sets meet.

    At a token of up to FEW sets pairs are listed and counted. At other tokens the leading tokens of all sets meet in one place, which
    is that of the least label there: near copies of one text, or the texts of one passage, have the same for most of their
    tokens, and meet in few places. Two sets that share a token of many sets meet there, and any others have all their shared
    tokens listed: no pair that may link (see may_link) is lost. Sets
    joined by such pairs meet whole, each in one place.
    """
    rows = leading.select("token", "sid", "place").join(F.broadcast(about) if small(about) else about, "sid", "left")
    rows = rows.select("token", "sid", "place", F.coalesce("comp", "sid").alias("comp"), F.coalesce("label", "sid").alias("label"))
    token = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("label").alias("meeting")).where("low < high")
    token = stored(token.select("token", "n", "meeting"), "tokens")
    rows = stored(rows.join(F.broadcast(token) if small(token) else token, "token"), "mixed")

    size = F.shiftright("place", 32).alias("size")
    few = rows.where(f"n <= {FEW}").select("token", "sid", "place", "comp").repartition("token").sortWithinPartitions("token")
    pairs = few.mapInArrow(_few_pairs(link), "member long, pivot long, at int, to int, m int, p int")
    pairs = pairs.groupBy("member", "pivot").agg(F.count(F.lit(1)).alias("shared"), F.max("at").alias("at"), F.max("to").alias("to"), F.first("m").alias("m"), F.first("p").alias("p"))
    pairs = stored(pairs.where(_may_link(link)).select("member", "pivot"), "pairs")
    crowd = rows.where(f"n > {FEW}")
    crowd = crowd.select(F.col("meeting").alias("owner"), "sid", "comp", size).distinct()
    crowd = stored(with_probes(crowd), "crowds")
    leads = rows.select("sid", "token", F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("at")).repartition("sid").sortWithinPartitions("sid", "token")
    met, to = _dealt(crowd, leads.mapInArrow(_one_each, "sid long, tokens binary, positions binary"), "crowd-places", 1 - link[0] / link[1])
    alike = stored(met.mapInArrow(_walk_leading(link), "a long, b long"), "alike")
    near = components(alike.unionByName(pairs.select(F.col("member").alias("a"), F.col("pivot").alias("b"))))
    forget(to, crowd, pairs, alike, token)
    whole = near.select(F.col("component").alias("owner"), F.col("node").alias("sid")).join(rows.select("sid", "comp", size).distinct(), "sid")
    return with_probes(whole)


def with_probes(placed: DataFrame) -> DataFrame:
    """owner, sid, comp, size, member, probe of places with sets of several components: all are members, and probes those outside
    the largest one there."""
    main = placed.groupBy("owner", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("owner").agg(F.max_by("comp", "k").alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return placed.join(main, "owner").select("owner", "sid", "comp", "size", F.lit(True).alias("member"), (F.col("comp") != F.col("main")).alias("probe"))
