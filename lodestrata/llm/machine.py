"""Byte pair encoding as a deterministic transducer over symbols, compiled state by state.

The input of the machine is one run of a text, as symbols: one per byte, the last of a run being
the closing form of its byte. A sequence of tokens is the encoding of its text exactly when each
adjacent pair is, hence every prefix has one last token: the one that ends there and that goes with
the last token of the prefix before it. A state holds what decides later steps: for each suffix
of the input that begins some token, its node in the trie of the vocabulary, the last token before
it, and how many tokens fewer the prefix before it has. So states are finite in number. A
transition by a symbol leads to a state and is annotated with the
change in the number of tokens; a closing symbol leads back to the first state. The changes along
a path sum up to the tokens of its text. States and transitions are made when first entered.
"""

from __future__ import annotations

#: States, and borders of tokens, kept in one worker process; beyond, the machine is compiled anew.
STATES, BORDERS = 200_000, 600_000
CLOSE = "</w>"


class Step(dict):
    """A state: symbol -> (state, change); ``threads`` hold (node, last token before, fewer)."""

    __slots__ = ("machine", "threads")

    def __init__(self, machine: Machine, threads: tuple):
        super().__init__()
        self.machine, self.threads = machine, threads

    def __missing__(self, symbol: str) -> tuple[Step, int]:
        made = self[symbol] = self.machine.step(self.threads, symbol)
        return made


class Machine:
    """Compiled from the ids of tokens and the ordered merges of a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.rank: dict[tuple[int, int], int] = {}
        symbols = {i: (t,) for t, i in vocabulary.items() if len(t) == 1 or (len(t) == 1 + len(CLOSE) and t.endswith(CLOSE))}
        #: What the token at either edge of a token was through its making: (token, rank at which it was merged).
        self.left: dict[int, list] = {i: [(i, None)] for i in symbols}
        self.right: dict[int, list] = {i: [(i, None)] for i in symbols}
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank[x, y] = rank
            if made in symbols:
                continue
            symbols[made] = symbols[x] + symbols[y]
            self.left[made] = [*self.left[x][:-1], (x, rank), (made, None)]
            self.right[made] = [*self.right[y][:-1], (y, rank), (made, None)]
        self.child: dict[tuple[int, str], int] = {}
        self.token: dict[int, int] = {}
        for i, path in symbols.items():
            node = 0
            for s in path:
                node = self.child.setdefault((node, s), len(self.child) + 1)
            self.token[node] = i
        self.clear()

    def clear(self) -> None:
        self.joins: dict[tuple[int, int], bool] = {}
        self.first = Step(self, ((0, None, 0),))
        self.states = {self.first.threads: self.first}

    def adjacent(self, a: int, b: int) -> bool:
        """Whether no merge reaches across the border of a and b while both are made."""
        known = self.joins.get((a, b))
        if known is not None:
            return known
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            across = self.rank.get((x, y))
            # Of equal merges the leftmost goes first: one inside a before the border, the border before one inside b.
            if across is not None and (x_end is None or across < x_end) and (y_end is None or across <= y_end):
                found = False
                break
            if x_end is None and y_end is None:
                found = True
                break
            if y_end is None or (x_end is not None and x_end <= y_end):
                i += 1
                j += x_end == y_end
            else:
                j += 1
        self.joins[a, b] = found
        return found

    def step(self, state: tuple, symbol: str) -> tuple[Step, int]:
        """The transition by a symbol from the state of these threads."""
        if len(self.states) >= STATES or len(self.joins) >= BORDERS:
            self.clear()
        threads, last, change = [], None, 0
        for node, before, fewer in state:
            to = self.child.get((node, symbol))
            if to is None:
                continue
            threads.append((to, before, fewer))
            token = self.token.get(to)
            if last is None and token is not None and (before is None or self.adjacent(before, token)):
                last, change = token, fewer + 1
        if len(symbol) > 1:
            return self.first, change
        key = (*((node, before, fewer - change) for node, before, fewer in threads), (0, last, 0))
        entered = self.states.get(key)
        if entered is None:
            entered = self.states[key] = Step(self, key)
        return entered, change

    def count(self, run: str) -> int:
        """Number of tokens of a run: the changes along its path."""
        state, total = self.first, 0
        for symbol in run[:-1]:
            state, change = state[symbol]
            total += change
        return total + state[run[-1] + CLOSE][1]
