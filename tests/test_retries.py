"""Waits between attempts at a provider."""

import inspect
import time

import pytest

from quarryline.operators import providers as PR


class Failing(PR.HashEmbedder):
    def __init__(self, times, wait=0.0):
        super().__init__(4)
        self.left, self.wait = times, wait

    def embed(self, texts):
        self.left -= 1
        if self.left >= 0:
            raise PR.Transient("busy", self.wait)
        return super().embed(texts)


def test_waits_double_and_are_spread():
    waits = []
    PR.embed_batch(Failing(4), ["a"], sleep=waits.append, jitter=lambda: 0.0)
    assert waits == [0.5, 1, 2, 4]
    spread = []
    PR.embed_batch(Failing(4), ["a"], sleep=spread.append)
    assert all(w / 2 <= x <= w for w, x in zip(waits, spread))


def test_the_provider_may_name_the_wait():
    waits = []
    PR.embed_batch(Failing(2, 7.0), ["a"], sleep=waits.append)
    assert waits == [7.0, 7.0]


def test_attempts_end():
    waits = []
    with pytest.raises(PR.Transient):
        PR.embed_batch(Failing(9), ["a"], attempts=3, sleep=waits.append)
    assert len(waits) == 2


def test_it_really_waits_by_default():
    assert inspect.signature(PR.embed_batch).parameters["sleep"].default is time.sleep
