"""An index for tests whose every second answer fails, once."""

from weftline.sources.ngrams import RateLimited


class Flaky:
    def __init__(self):
        self.failed = set()

    def segments(self, query):
        return [(0, 0, 5), (1, 0, 5)]

    def hits(self, query, shard, first, end):
        for rank in range(first, end):
            if rank % 2 and (shard, rank) not in self.failed:
                self.failed.add((shard, rank))
                raise RateLimited(0)
            yield rank, {"doc_id": f"{shard}-{rank}", "spans": [query]}


def client(options):
    return Flaky()
