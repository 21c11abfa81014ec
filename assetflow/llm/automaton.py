"""Small deterministic automata over bytes: Thompson construction, subset construction, minimisation."""

from __future__ import annotations

from collections import defaultdict


class Nfa:
    """States are numbers; ``edges[s]`` are (set of bytes, next), ``jumps[s]`` are moves without a byte."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.jumps: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.jumps.append([])
        return len(self.edges) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` behind ``start`` and returns its end. A node is a set of bytes or a tuple: ("seq", ...), ("any", ...)
        for alternatives, ("opt", x), ("star", x), ("plus", x), ("times", x, n)."""
        if isinstance(node, frozenset):
            end = self.state()
            self.edges[start].append((node, end))
            return end
        kind, *parts = node
        if kind == "seq":
            for p in parts:
                start = self.build(p, start)
            return start
        if kind == "any":
            end = self.state()
            for p in parts:
                self.jumps[self.build(p, start)].append(end)
            return end
        if kind == "opt":
            end = self.state()
            self.jumps[start].append(end)
            self.jumps[self.build(parts[0], start)].append(end)
            return end
        if kind == "star":
            loop = self.state()
            self.jumps[start].append(loop)
            self.jumps[self.build(parts[0], loop)].append(loop)
            return loop
        if kind == "plus":
            return self.build(("seq", parts[0], ("star", parts[0])), start)
        if kind == "times":
            return self.build(("seq", *[parts[0]] * parts[1]), start)
        raise ValueError(kind)


def bytes_of(text: str) -> frozenset:
    return frozenset(text.encode())


def word(text: str, any_case: bool = False) -> tuple:
    return ("seq", *[bytes_of(c.lower() + c.upper() if any_case else c) for c in text])


def reverse(node):
    if isinstance(node, frozenset):
        return node
    kind, *parts = node
    if kind == "times":
        return (kind, reverse(parts[0]), parts[1])
    parts = [reverse(p) for p in parts]
    if kind == "plus":
        return ("seq", ("star", parts[0]), parts[0])
    return (kind, *(parts[::-1] if kind == "seq" else parts))


class Dfa:
    """``rows[s][b]`` is the next state's row and ``rows[s][256]`` the rules that accept in s (a bit mask); row 0 starts."""

    def __init__(self, table: list[list[int]], accept: list[int]):
        self.table, self.accept = table, accept
        self.rows: list[list] = [[] for _ in table]
        for row, to, mask in zip(self.rows, table, accept, strict=True):
            row.extend([self.rows[t] for t in to])
            row.append(mask)
        #: The state that no byte leaves and no rule accepts, if there is one.
        self.sink = next((row for row in self.rows if not row[256] and all(row[b] is row for b in range(256))), None)


def compile_rules(nodes: list, anywhere: bool) -> Dfa:
    """One minimal automaton for all rules; ``anywhere`` lets a match begin at any byte."""
    nfa = Nfa()
    root = nfa.state()
    ends = [nfa.build(n, root) for n in nodes]

    def closed(states) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for t in nfa.jumps[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    start = closed({root})
    ids, queue, table = {start: 0}, [start], []
    for states in queue:  # subset construction; grows while it runs
        to: dict[int, set] = defaultdict(set)
        for s in states:
            for chars, t in nfa.edges[s]:
                for b in chars:
                    to[b].add(t)
        row = []
        for b in range(256):
            nxt = closed(to.get(b, set()) | ({root} if anywhere else set()))
            if nxt not in ids:
                ids[nxt] = len(queue)
                queue.append(nxt)
            row.append(ids[nxt])
        table.append(row)
    accept = [sum(1 << r for r, e in enumerate(ends) if e in states) for states in queue]
    # Minimisation: split classes of states until all members of a class move to the same classes.
    part = accept
    while True:
        seen: dict[tuple, int] = {}
        new = [seen.setdefault((part[s], *[part[t] for t in table[s]]), len(seen)) for s in range(len(table))]
        if len(seen) == len(set(part)):
            break
        part = new
    names: dict[int, int] = {}
    for p in part:
        names.setdefault(p, len(names))
    small: list[list[int]] = [[] for _ in names]
    masks = [0] * len(names)
    for s, p in enumerate(part):
        if not small[names[p]]:
            small[names[p]] = [names[part[t]] for t in table[s]]
            masks[names[p]] = accept[s]
    return Dfa(small, masks)
