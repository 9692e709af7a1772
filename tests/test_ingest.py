import pytest

from logweave import ingest, runs
from logweave.functions import permissions as P
from logweave.sources import rest
from logweave.warehouse import Warehouse

from simulated_api import serving

VIEW, HISTORY, THREADS = P.VIEW_CHANNEL, P.READ_MESSAGE_HISTORY, P.MANAGE_THREADS


def message(i, channel):
    user = {"id": str(i % 3 + 1), "username": f"u{i % 3}"}
    return {"id": str(i), "channel_id": str(channel), "author": user, "content": f"m{i}", "timestamp": "2024-01-01T00:00:00Z", "type": 0}


def thread(i, parent, at):
    return {"id": str(i), "type": 11, "name": f"t{i}", "parent_id": str(parent), "thread_metadata": {"archive_timestamp": at}}


def paged(*all_threads):
    def answer(params):
        rest_of = [t for t in all_threads if "before" not in params or t["thread_metadata"]["archive_timestamp"] < params["before"]]
        return {"threads": rest_of[:1], "has_more": len(rest_of) > 1}

    return answer


def world():
    """A guild with a text channel, a hidden one, one whose messages are denied, a voice channel, and archived threads."""
    everyone = {"id": "9", "name": "everyone", "permissions": str(VIEW | HISTORY)}
    crew = {"id": "5", "name": "crew", "permissions": str(THREADS)}
    hidden = [{"id": "9", "type": 0, "allow": "0", "deny": str(VIEW)}]
    answers = {
        "/guilds/9": {"id": "9", "name": "G", "roles": [everyone, crew]},
        "/users/@me": {"id": "77"},
        "/users/@me/guilds/9/member": {"roles": ["5"]},
        "/guilds/9/emojis": [{"id": "31", "name": "x"}],
        "/guilds/9/stickers": 403,
        "/guilds/9/scheduled-events": [],
        "/guilds/9/channels": [
            {"id": "100", "guild_id": "9", "type": 0, "name": "talk", "parent_id": "50"}, {"id": "101", "guild_id": "9", "type": 0, "name": "secret", "permission_overwrites": hidden},
            {"id": "102", "guild_id": "9", "type": 0, "name": "denied"}, {"id": "103", "guild_id": "9", "type": 2, "name": "voice"}, {"id": "104", "guild_id": "9", "type": 4, "name": "category"},
        ],
        "/channels/100/threads/archived/public": paged(thread(201, 100, "t3"), thread(202, 100, "t2")),
        "/channels/100/threads/archived/private": paged(thread(203, 100, "t1")),
        "/channels/102/threads/archived/public": 403,
        "/channels/102/messages": 403,
        "/channels/100": {"id": "100", "guild_id": "9", "type": 0},
    }
    return answers, {100: [message(i, 100) for i in range(1, 251)], 201: [message(900, 201)], 101: [message(901, 101)]}


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, str(tmp_path), buckets=2)


def test_a_guild_step_by_step(wh):
    answers, messages = world()
    with serving(answers, messages, {"/guilds/9/emojis": [429, 429]}) as (url, asked):
        account = ingest.Account("a", rest.Patient(rest.HttpFetcher(url, "token")), (9,))
        told = ingest.run(wh, [account])[9]
        assert told == {"roles": 2, "emojis": 1, "stickers": None, "events": 0, "channels": 8, "channels_read": 5, "messages": 251}
        assert {r["channel_id"]: r["parent_id"] for r in wh.read("channels").collect()} == {100: None, 101: None, 102: None, 103: None, 104: None, 201: 100, 202: 100, 203: 100}
        assert wh.read("messages").count() == 251 and not any(p == "/channels/101/messages" for p, _ in asked)
        bounds = {r["channel_id"]: (r["oldest"], r["newest"], r["complete"]) for r in wh.read("bounds").collect()}
        assert bounds[100] == (1, 250, True) and bounds[202] == (None, None, True) and bounds[102][2] is False
        messages[100] += [message(i, 100) for i in range(251, 360)]
        answers["/channels/102/messages"] = []
        assert ingest.run(wh, [account], guild_id=9)[9]["messages"] == 109 and ingest.run(wh, [account], guild_id=8) == {}
        assert runs.incomplete_backfills(wh).count() == 0


def test_one_channel_by_the_account_that_sees_it(wh):
    answers, messages = world()
    with serving({"/channels/100": 403}, {}) as (other, _), serving(answers, messages) as (url, _):
        accounts = [ingest.Account(n, rest.Patient(rest.HttpFetcher(u, "t")), (9,)) for n, u in (("blind", other), ("seeing", url))]
        assert ingest.run(wh, accounts, channel_id=100) == {9: {"channels_read": 1, "messages": 250}}
        assert ingest.run(wh, accounts, channel_id=555) == {}


def test_an_error_ends_the_run(wh):
    answers, messages = world()
    answers["/guilds/9/stickers"] = 404
    with serving(answers, messages) as (url, _), pytest.raises(rest.ApiError):
        ingest.run(wh, [ingest.Account("a", rest.Patient(rest.HttpFetcher(url, "t")), (9,))])
    assert wh.has("emojis") and not wh.has("channels")  # steps before stay


def test_patience():
    waited, left = [], [503, 429, OSError("reset"), 200]

    def fetch(path, params):
        got = left.pop(0)
        if isinstance(got, OSError):
            raise got
        if got != 200:
            raise rest.ApiError(got, retry_after=0.5 if got == 429 else None)
        return [path, params]

    assert rest.Patient(fetch, waited.append)("/x") == ["/x", {}] and waited == [1.0, 0.5, 2.0]
    with pytest.raises(rest.ApiError):
        rest.Patient(lambda p, q: (_ for _ in ()).throw(rest.ApiError(500)), lambda s: None)("/x")


def test_sources_read_on_executors(spark, tmp_path):
    answers, messages = world()
    rest.register(spark)
    with serving(answers, messages) as (url, _):
        read = lambda **o: spark.read.format("chat_pages").options(url=url, token="t", **o).load()
        assert {r["channel_id"]: r["count"] for r in read(channels="100,102,201").groupBy("channel_id").count().collect()} == {100: 250, 201: 1}
        assert read(channels="100", before="100").count() == 99
        answers |= {f"/channels/{c}": {"id": str(c), "last_message_id": last} for c, last in ((100, "170"), (201, None))}

        def forward():
            stream = spark.readStream.format("chat_pages").options(url=url, token="t", channels="100,201", ranges="3", after="20").load()
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(once=True).start().awaitTermination()
            return sorted(int(r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("get_json_object(raw, '$.id') id").collect())

        assert forward() == list(range(21, 171))
        answers["/channels/100"]["last_message_id"] = "250"
        answers["/channels/201"]["last_message_id"] = "900"
        assert forward() == [*range(21, 251), 900]  # goes on after a restart
