"""Grammar notation, LALR(1) tables with all conflicting actions kept, and a parser that follows them in parallel.

A grammar is text: ``name : a b | c ? ;`` with symbols apart by blanks. A symbol that no rule defines is a token kind. ``x?``, ``x*`` and
``x+`` stand for the usual shorthands, ``%empty`` for nothing. Where a grammar is ambiguous, ``Parser`` follows every action (generalised
LR) and merges stacks that agree, so that a text is accepted exactly if the grammar derives it. ``%shift tok ...`` names tokens for which
a shift is taken instead of a reduction, where both accept the same texts.
"""

from __future__ import annotations

from itertools import chain

END = "$end"


def _read(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], set[str]]:
    rules: list[tuple[str, tuple[str, ...]]] = []
    shift: set[str] = set()
    made: set[str] = set()

    def sugar(sym: str) -> str:
        if len(sym) > 1 and sym[-1] in "?*+" and (sym[0].isalnum() or sym[0] in "_'"):
            base = sym[:-1]
            if sym not in made:
                made.add(sym)
                if sym[-1] == "?":
                    rules.extend([(sym, ()), (sym, (base,))])
                elif sym[-1] == "*":
                    rules.extend([(sym, ()), (sym, (sym, base))])
                else:
                    rules.extend([(sym, (base,)), (sym, (sym, base))])
        return sym

    for block in text.split(" ;\n"):
        words = block.split()
        if not words:
            continue
        if words[0] == "%shift":
            shift.update(words[1:])
            continue
        head, colon, *body = words
        assert colon == ":", block
        alternative: list[str] = []
        for w in [*body, "|"]:
            if w == "|":
                rules.append((head, tuple(sugar(x) for x in alternative if x != "%empty")))
                alternative = []
            else:
                alternative.append(w.strip("'") if w.startswith("'") and len(w) > 2 and w.endswith("'") else w)
    return rules, shift


class Tables:
    """``action[state][token]``: a shift (target + 1), a reduction (-rule), or a tuple of several; ``goto[state][symbol]``."""

    def __init__(self, grammar: str):
        rules, shift = _read(grammar)
        start = next(w[0] for w in map(str.split, grammar.split(" ;\n")) if w and w[0] != "%shift")
        rules = [("$start", (start, END)), *rules]
        heads: dict[str, list[int]] = {}
        for i, (h, _) in enumerate(rules):
            heads.setdefault(h, []).append(i)
        self.rules = [(h, len(b)) for h, b in rules]
        productive: set[str] = set()
        while more := {h for h, b in rules if h not in productive and all(x in productive or x not in heads for x in b)}:
            productive |= more
        if barren := heads.keys() - productive:  # such as a rule that has the name of the keyword it should begin with
            raise ValueError(f"rules that derive nothing: {sorted(barren)}")
        # LR(0) states
        closures: dict[frozenset, list] = {}

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            items, seen, todo = list(kernel), set(), list(kernel)
            while todo:
                r, d = todo.pop()
                body = rules[r][1]
                if d < len(body) and body[d] in heads and body[d] not in seen:
                    seen.add(body[d])
                    new = [(x, 0) for x in heads[body[d]]]
                    items += new
                    todo += new
            return items

        first = frozenset([(0, 0)])
        number, order, moves = {first: 0}, [first], []
        at = 0
        while at < len(order):
            items = closures[order[at]] = closure(order[at])
            by: dict[str, set] = {}
            for r, d in items:
                body = rules[r][1]
                if d < len(body):
                    by.setdefault(body[d], set()).add((r, d + 1))
            out = {}
            for sym, kernel in by.items():
                k = frozenset(kernel)
                if k not in number:
                    number[k] = len(order)
                    order.append(k)
                out[sym] = number[k]
            moves.append(out)
            at += 1
        # nullable
        nullable: set[str] = set()
        grew = True
        while grew:
            grew = False
            for h, b in rules:
                if h not in nullable and all(x in nullable for x in b):
                    nullable.add(h)
                    grew = True
        terms = sorted({x for _, b in rules for x in b if x not in heads})
        bit = {t: 1 << i for i, t in enumerate(terms)}
        trans = [(p, x) for p, out in enumerate(moves) for x in out if x in heads]
        index = {t: i for i, t in enumerate(trans)}
        follow = [0] * len(trans)
        reads: list[list[int]] = [[] for _ in trans]
        for i, (p, x) in enumerate(trans):
            r = moves[p][x]
            for sym in moves[r]:
                if sym in heads:
                    if sym in nullable:
                        reads[i].append(index[r, sym])
                else:
                    follow[i] |= bit[sym]
        includes: list[list[int]] = [[] for _ in trans]
        lookback: dict[tuple[int, int], list[int]] = {}
        for i, (p, x) in enumerate(trans):
            for r in heads[x]:
                body, q = rules[r][1], p
                for k, sym in enumerate(body):
                    if sym in heads and all(y in nullable for y in body[k + 1 :]):
                        includes[index[q, sym]].append(i)
                    q = moves[q][sym]
                lookback.setdefault((q, r), []).append(i)
        for edges in (reads, includes):
            users: list[list[int]] = [[] for _ in trans]
            for i, to in enumerate(edges):
                for j in to:
                    users[j].append(i)
            todo = list(range(len(trans)))
            while todo:
                j = todo.pop()
                for i in users[j]:
                    if follow[j] & ~follow[i]:
                        follow[i] |= follow[j]
                        todo.append(i)
        self.action: list[dict[str, object]] = []
        self.goto: list[dict[str, int]] = []
        self.conflicts = 0
        for p, out in enumerate(moves):
            acts: dict[str, list[int]] = {}
            for sym, q in out.items():
                if sym not in heads:
                    acts.setdefault(sym, []).append(q + 1)
            for r, d in closures[order[p]]:
                if r and d == len(rules[r][1]):
                    la = 0
                    for i in lookback.get((p, r), ()):
                        la |= follow[i]
                    for t in terms:
                        if la & bit[t]:
                            acts.setdefault(t, []).append(-r)
            row: dict[str, object] = {}
            for t, a in acts.items():
                if len(a) > 1 and t in shift and max(a) > 0:
                    a = [max(a)]
                self.conflicts += len(a) > 1
                row[t] = a[0] if len(a) == 1 else tuple(a)
            self.action.append(row)
            self.goto.append({s: q for s, q in out.items() if s in heads})


class Parser:
    """Accepts token streams; ``tokens`` yields (kind, line, newline_before), and END comes of itself.

    ``first`` maps a kind to the kind to be tried before it (a brace that can open a block does). ``virtual`` names the token that may be
    put in where a token does not fit and stands on a new line, or is one of ``closers``.
    """

    def __init__(self, tables: Tables, first: dict[str, str] | None = None, virtual: str | None = None, closers: frozenset[str] = frozenset()):
        self.t, self.first, self.virtual, self.closers = tables, first or {}, virtual, closers
        self.memo: dict[tuple[int, int, str], tuple[int, object]] = {}

    def error(self, tokens) -> tuple[int, str] | None:
        """None if the stream parses, else (line, kind) of the first token that no parse can take.

        ``tokens`` is a stream, or a function that makes one from ``can``: ``can(kind)`` tells, before each token, whether some parse could
        take that kind next, for languages whose tokens depend on it.
        """
        action, goto, rules, memo = self.t.action, self.t.goto, self.t.rules, self.memo
        first, virtual, closers = self.first, self.virtual, self.closers
        stack = [0]
        heads: list | None = None  # linked stacks (state, rest) while several parses are alive

        def linked() -> list:
            if heads is not None:
                return heads
            node = None
            for s in stack:
                node = (s, node)
            return [node]

        def can(kind: str) -> bool:
            return bool(self._step(linked(), (kind,))[0])

        for kind, line, fresh in self._ended(tokens(can)) if callable(tokens) else chain(tokens, ((END, 0, True),)):
            if heads is None and kind not in first:  # the common case: one parse, one reading of the token
                top = stack[-1]
                act = action[top].get(kind)
                while type(act) is int:
                    if act > 0:
                        stack.append(act - 1)
                        break
                    head, n = rules[-act]
                    if n == 1:  # a chain of such reductions depends on what lies under it and the token: remembered
                        under = stack[-2]
                        key = (under, top, kind)
                        hit = memo.get(key)
                        if hit is None:
                            state, a = top, act
                            while type(a) is int and a < 0 and rules[-a][1] == 1:
                                state = goto[under][rules[-a][0]]
                                a = action[state].get(kind)
                            hit = memo[key] = (state, a)
                        top, act = hit
                        stack[-1] = top
                        continue
                    if n:
                        del stack[-n:]
                    top = goto[stack[-1]][head]
                    stack.append(top)
                    act = action[top].get(kind)
                if type(act) is int:
                    continue
            tried = (first[kind], kind) if kind in first else (kind,)
            inserted = False
            while True:
                if heads is None:
                    top = stack[-1]
                    now = kind if len(tried) == 1 or tried[0] not in action[top] else tried[0]
                    act = action[top].get(now)
                    while type(act) is int:
                        if act > 0:
                            stack.append(act - 1)
                            break
                        head, n = rules[-act]
                        if n:
                            del stack[-n:]
                        top = goto[stack[-1]][head]
                        stack.append(top)
                        act = action[top].get(now)
                    if type(act) is int:
                        break
                    if act is not None:
                        heads = linked()
                if heads is not None:
                    new, left = self._step(heads, tried)
                    if new:
                        if len(new) == 1:
                            heads, stack, node = None, [], new[0]
                            while node is not None:
                                stack.append(node[0])
                                node = node[1]
                            stack.reverse()
                        else:
                            heads = new
                        break
                    heads = left or heads
                if virtual and not inserted and (fresh or kind in closers):
                    inserted = True
                    new, _ = self._step(linked(), (virtual,))
                    if new:
                        heads = new
                        continue
                return line or (tokens[-1][1] if not callable(tokens) and tokens else 1), kind
        return None

    def _ended(self, tokens):
        line = 1
        for tok in tokens:
            line = tok[1]
            yield tok
        yield END, line, True

    def _step(self, heads: list, tried: tuple[str, ...]) -> tuple[list, list]:
        """All stacks after shifting the token; and, for the case that there is none, the stacks as far as they reduced."""
        action, goto, rules = self.t.action, self.t.goto, self.t.rules
        shifted: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int], tuple] = {}
        todo, dead = list(heads), []
        while todo:
            node = todo.pop()
            row = action[node[0]]
            kind = tried[0] if len(tried) > 1 and tried[0] in row else tried[-1]
            act = row.get(kind)
            if act is None:
                dead.append(node)
                continue
            for a in act if type(act) is tuple else (act,):
                if a > 0:
                    shifted.setdefault((a, id(node)), (a - 1, node))
                    continue
                head, n = rules[-a]
                base = node
                for _ in range(n):
                    base = base[1]
                key = (goto[base[0]][head], id(base))
                if key not in seen:
                    seen[key] = (key[0], base)
                    todo.append(seen[key])
        return list(shifted.values()), dead
