"""The table function of samples, by itself."""

import time


def test_samples_of_a_payload_come_row_by_row_and_without_python_work_for_each():
    import numpy as np

    from slicewise.operators import codec
    from slicewise.streaming.session import FramePixels

    planes = [np.random.default_rng(k).integers(0, 256, 21 * 8).astype(np.uint8).tobytes() for k in range(3)]
    chunk = codec.encode_one("ULRG", 21, 8, 3, 2, planes)
    rows = list(FramePixels().eval(chunk, "ULRG", 21, 8, 2))
    assert rows == [(k, at // 21, at % 21, v) for k, p in enumerate(planes) for at, v in enumerate(p)]
    assert list(FramePixels().eval(chunk[:-1], "ULRG", 21, 8, 2)) == []
    flat = [bytes(1 << 21)] * 3  # one symbol: decoding takes next to nothing
    chunk = codec.encode_one("ULY4", 1 << 11, 1 << 10, 0, 1, flat)
    began = time.process_time()
    assert sum(1 for _ in FramePixels().eval(chunk, "ULY4", 1 << 11, 1 << 10, 1)) == 3 << 21
    own = time.process_time() - began
    began = time.process_time()
    assert sum(1 for _ in ((0, *divmod(at, 1 << 11), v) for p in flat for at, v in enumerate(p))) == 3 << 21
    assert own < (time.process_time() - began) * 0.8
