import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.operators.bitmaps import Container

SETS = st.one_of(st.sets(st.integers(0, 65535), max_size=60), st.builds(lambda a, n: set(range(a, min(a + n, 65536))), st.integers(0, 65535), st.integers(0, 9000)), st.builds(lambda s: set(range(s, 65536, 3)), st.integers(0, 5)))


@settings(max_examples=80, deadline=None)
@given(SETS, SETS)
def test_set_operations(a, b):
    x, y = Container.of(np.array(sorted(a), dtype=np.int64)), Container.of(np.array(sorted(b), dtype=np.int64))
    assert set(x.values().tolist()) == a
    assert set((x | y).values().tolist()) == a | b
    assert set((x & y).values().tolist()) == a & b
    assert set(x.andnot(y).values().tolist()) == a - b
    assert x.nbytes() <= 8192
