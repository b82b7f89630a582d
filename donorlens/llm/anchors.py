"""Anchors-hierarchy metric trees over integer vectors, and nearest entries by lists of candidates that shrink on the way down.

A tree is built middle-out: about sqrt(n) anchors, each the point farthest from the anchor that owned it, take the points
nearest to them; the anchors' balls are joined bottom-up, nearest first, and what an anchor owns is split the same way. A
ball caches the sum and the count of its points, which are neighbours in one order of the tree's points.

An entry leaves a ball's list when another is nearer to every point of the ball. The bounds are floating-point numbers with a
margin, so they only ever keep an entry too many; who is nearest is decided by integers, ties by the lower index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a ball that is not divided further, and anchors from which on a layer is wide enough.
LEAF, FEW = 64, 4
#: Part of a bound, and distance, by which floating-point numbers may be off, for components of up to LARGEST.
SLACK, NEAR, LARGEST = 1e-9, 1e-6, 1 << 26


@dataclass(frozen=True)
class Tree:
    """`order`: the points' places, a ball's next to each other; for each ball `low` and `high` in that order, `left` and
    `right` (-1 for none), the number of its level (0 for the root), `centers`, `radii`, and `sums` of its points."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    level: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    sums: np.ndarray


def _squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    off = points - center
    return np.einsum("ij,ij->i", off, off)


def anchors(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the number of the anchor that owns it; the anchors' places, and their balls' radii. Equal points have
    one owner, so there may be fewer anchors than `most`."""
    owner = np.zeros(len(points), np.int64)
    distance = np.sqrt(_squares(points, points[0]))
    places, radii = [0], [float(distance.max())]
    while len(places) < most:
        widest = int(np.argmax(radii))
        if not radii[widest]:
            break
        own = np.flatnonzero(owner == widest)
        new = int(own[np.argmax(distance[own])])
        # Only points of anchors that reach far enough can be nearer to the new anchor than half-way.
        between = np.sqrt(_squares(points[places], points[new]))
        open_ = np.flatnonzero(between < 2 * np.array(radii) * (1 + SLACK))
        near = np.flatnonzero(np.isin(owner, open_)) if len(open_) < len(places) else np.arange(len(points))
        far = np.sqrt(_squares(points[near], points[new]))
        stolen = far < distance[near]
        places.append(new)
        owner[near[stolen]] = len(places) - 1
        distance[near[stolen]] = far[stolen]
        owner[new], distance[new] = len(places) - 1, 0.0
        radii.append(0.0)
        longest = np.zeros(len(places))
        np.maximum.at(longest, owner, distance)
        radii = longest.tolist()
    return owner, np.array(places), np.array(radii)


def _joined(centers: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The order in which balls are joined: pairs of numbers, a join makes the next number."""
    n = len(radii)
    centers, radii, counts = centers.astype(float), radii.astype(float), counts.astype(float)
    numbers, pairs = np.arange(n), []
    across = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
    size = (across + radii[:, None] + radii[None]) / 2
    np.fill_diagonal(size, np.inf)
    for k in range(n - 1):
        a, b = np.unravel_index(int(np.argmin(size)), size.shape)
        pairs.append((int(numbers[a]), int(numbers[b])))
        total = counts[a] + counts[b]
        center = (centers[a] * counts[a] + centers[b] * counts[b]) / total
        radius = max(np.sqrt(((centers[i] - center) ** 2).sum()) + radii[i] for i in (a, b))
        centers[a], radii[a], counts[a], numbers[a] = center, radius, total, n + k
        radii[b] = np.inf
        row = (np.sqrt(((centers - center) ** 2).sum(1)) + radii + radius) / 2
        row[a] = np.inf
        size[a], size[:, a] = row, row
        size[b], size[:, b] = np.inf, np.inf
    return pairs


def build(points: np.ndarray) -> Tree:
    """The tree of the integer vectors `points`, at least one."""
    points = points.astype(np.int64)
    left, right, owned = [], [], []  # of each ball; the places of a leaf's points

    def leaf(places: np.ndarray) -> int:
        left.append(-1)
        right.append(-1)
        owned.append(places)
        return len(left) - 1

    def divided(places: np.ndarray) -> int:
        if len(places) <= LEAF:
            return leaf(places)
        owner, _, radii = anchors(points[places], max(FEW, int(np.sqrt(len(places)))))
        if len(radii) == 1:
            return leaf(places)  # equal points
        by_owner = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(radii))
        groups = np.split(by_owner, np.cumsum(counts)[:-1])
        means = np.stack([points[places[g]].mean(0) for g in groups])
        reach = np.array([np.sqrt(_squares(points[places[g]].astype(float), m).max()) for g, m in zip(groups, means, strict=True)])
        balls = [divided(places[g]) for g in groups]
        for a, b in _joined(means, reach, counts):
            left.append(balls[a])
            right.append(balls[b])
            owned.append(None)
            balls.append(len(left) - 1)
        return balls[-1]

    root = divided(np.arange(len(points)))
    n = len(left)
    left_of, right_of = np.array(left), np.array(right)
    low, high, level = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, open_, at = [], [(root, 0)], 0
    visited = []
    while open_:
        ball, depth = open_.pop()
        level[ball] = depth
        visited.append(ball)
        low[ball] = at
        if left[ball] < 0:
            order.append(owned[ball])
            at += len(owned[ball])
        else:
            open_ += [(right[ball], depth + 1), (left[ball], depth + 1)]
    for ball in reversed(visited):
        high[ball] = high[right[ball]] if left[ball] >= 0 else low[ball] + len(owned[ball])
    places = np.concatenate(order)
    sorted_ = points[places]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(sorted_, 0)])
    sums = running[high] - running[low]
    centers = sums / (high - low)[:, None]
    radii = np.array([np.sqrt(_squares(sorted_[a:b].astype(float), c).max()) for a, b, c in zip(low, high, centers, strict=True)])
    return Tree(places, low, high, left_of, right_of, level, centers, radii * (1 + SLACK) + NEAR, sums)


def first_of_equals(entries: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of those equal to it; the others can never be chosen."""
    first = np.zeros(len(entries), bool)
    first[np.unique(entries, axis=0, return_index=True)[1]] = True
    return first


def owners(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that one entry owns as a whole (all of them apart) and that entry, and the places of all other points and theirs.

    Level by level: a ball inherits its parent's list of candidates, and of the entries in it those go that are farther than
    the center's nearest one from every point of the ball.
    """
    exact = entries.astype(float)
    apart = np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(2))
    balls = np.flatnonzero(tree.level == 0)
    lists = np.tile(first_of_equals(entries), (1, 1))
    whole, whole_entry, rest, rest_lists = [], [], [], []
    while len(balls):
        squares = ((tree.centers[balls][:, None] - exact[None]) ** 2).sum(2)
        nearest = np.where(lists, squares, np.inf).argmin(1)
        least = squares[np.arange(len(balls)), nearest][:, None]
        bound = 2 * tree.radii[balls][:, None] * apart[nearest] + SLACK * (squares + least) + NEAR
        lists = lists & ~(squares - least > bound)
        alone = lists.sum(1) == 1
        whole.append(balls[alone])
        whole_entry.append(lists[alone].argmax(1))
        is_leaf = (tree.left[balls] < 0) & ~alone
        rest.append(balls[is_leaf])
        rest_lists.append(lists[is_leaf])
        inner = ~alone & ~is_leaf
        lists = np.concatenate([lists[inner], lists[inner]])
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
    leaves, lists = np.concatenate(rest), np.concatenate(rest_lists)
    sizes = tree.high[leaves] - tree.low[leaves]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ball_of = np.repeat(np.arange(len(leaves)), sizes)
    places = tree.order[np.arange(starts[-1]) - starts[ball_of] + tree.low[leaves][ball_of]]
    return np.concatenate(whole), np.concatenate(whole_entry), places, _nearest(points, places, lists, ball_of, entries)


def _nearest(points: np.ndarray, places: np.ndarray, lists: np.ndarray, ball_of: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, of those in its leaf's list: exact, ties to the lower index."""
    if not len(places):
        return np.zeros(0, np.int64)
    point, entry = np.nonzero(lists[ball_of])
    off = points[places[point]].astype(np.int64) - entries[entry]
    square = np.einsum("ij,ij->i", off, off)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(point) != 0]))
    least = np.minimum.reduceat(square, begins)
    tied = np.where(square == least[point], entry, len(entries))
    return np.minimum.reduceat(tied, begins)


def entry_sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the count of the points of each entry."""
    balls, of_ball, places, of_point = owners(tree, points, entries)
    sums = np.zeros(entries.shape, np.int64)
    counts = np.zeros(len(entries), np.int64)
    np.add.at(sums, of_ball, tree.sums[balls])
    np.add.at(counts, of_ball, tree.high[balls] - tree.low[balls])
    np.add.at(sums, of_point, points[places].astype(np.int64))
    np.add.at(counts, of_point, 1)
    return sums, counts


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point."""
    balls, of_ball, places, of_point = owners(tree, points, entries)
    out = np.empty(len(points), np.int64)
    out[places] = of_point
    for low, high, entry in zip(tree.low[balls], tree.high[balls], of_ball, strict=True):
        out[tree.order[low:high]] = entry
    return out
