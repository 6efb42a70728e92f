"""Flow message sources: Kafka topic, protobuf frames, decoded parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark import schema

# Message name, field numbers and wire types of the flow message.
# Only the stored fields are listed; decoders skip all others (VLAN, MPLS, AS
# path, communities, layer stack, fragments, segment routing, flow label).
PACKAGE, MESSAGE = "flowpb", "FlowMessage"
FIELDS = {
    "type": (1, "uint32"),
    "sequence_num": (4, "uint32"),
    "sampling_rate": (3, "uint64"),
    "sampler_address": (11, "bytes"),
    "time_received_ns": (110, "uint64"),
    "time_flow_start_ns": (111, "uint64"),
    "time_flow_end_ns": (112, "uint64"),
    "bytes": (9, "uint64"),
    "packets": (10, "uint64"),
    "src_addr": (6, "bytes"),
    "dst_addr": (7, "bytes"),
    "etype": (30, "uint32"),
    "proto": (20, "uint32"),
    "ip_tos": (23, "uint32"),
    "ip_ttl": (25, "uint32"),
    "ip_flags": (38, "uint32"),
    "tcp_flags": (26, "uint32"),
    "icmp_type": (31, "uint32"),
    "icmp_code": (32, "uint32"),
    "src_port": (21, "uint32"),
    "dst_port": (22, "uint32"),
    "src_as": (14, "uint32"),
    "dst_as": (15, "uint32"),
    "src_net": (16, "uint32"),
    "dst_net": (17, "uint32"),
    "next_hop": (12, "bytes"),
    "next_hop_as": (13, "uint32"),
    "bgp_next_hop": (100, "bytes"),
    "in_if": (18, "uint32"),
    "out_if": (19, "uint32"),
    "src_mac": (27, "uint64"),
    "dst_mac": (28, "uint64"),
    "forwarding_status": (24, "uint32"),
    "observation_domain_id": (70, "uint32"),
    "observation_point_id": (71, "uint32"),
}


def kafka_flows(
    spark: SparkSession,
    servers: str,
    topic: str = "flows",
    starting_offsets: str = "latest",
    min_partitions: int | None = None,
    max_offsets: int = 5_000_000,
) -> DataFrame:
    """Stream of Kafka records; needs the Kafka connector on the class path.

    The query's checkpoint takes the place of a consumer group.
    ``min_partitions`` splits topic partitions further when there are few;
    ``max_offsets`` bounds a micro-batch, so that a backlog is read in several.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("maxOffsetsPerTrigger", max_offsets)
    )
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.load()


def file_flows(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of parquet files that hold decoded flow messages."""
    reader = spark.readStream.schema(schema.FLOW)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def unframe(value: str) -> str:
    """SQL text: message bytes without their leading varint length."""
    head = rf"regexp_extract(hex(substring({value}, 1, 10)), '^(([89A-F].)*[0-7].)', 1)"
    return f"substring({value}, 1 + CAST(length({head}) / 2 AS INT))"


def descriptor_set() -> bytes:
    """Serialized description of the message for the decoders."""
    from google.protobuf import descriptor_pb2 as pb

    kinds = {
        "uint32": pb.FieldDescriptorProto.TYPE_UINT32,
        "uint64": pb.FieldDescriptorProto.TYPE_UINT64,
        "bytes": pb.FieldDescriptorProto.TYPE_BYTES,
    }
    files = pb.FileDescriptorSet()
    file = files.file.add(name="flow.proto", package=PACKAGE, syntax="proto3")
    message = file.message_type.add(name=MESSAGE)
    for name, (number, kind) in FIELDS.items():
        message.field.add(
            name=name, number=number, type=kinds[kind], label=pb.FieldDescriptorProto.LABEL_OPTIONAL
        )
    return files.SerializeToString()


def message_class(descriptors: bytes):
    """Python class of the message, for producers and tests."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"{PACKAGE}.{MESSAGE}"))


def from_descriptors(payload: Column) -> Column:
    """Spark's own decoder; needs its protobuf module on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return from_protobuf(
        payload,
        f"{PACKAGE}.{MESSAGE}",
        options={"emit.default.values": "true"},
        binaryDescriptorSet=descriptor_set(),
    )


def decode_flows(
    records: DataFrame,
    value: str = "value",
    framed: bool = True,
    decoder: Callable[[Column], Column] = from_descriptors,
) -> DataFrame:
    """Protobuf records to flow messages with the stored columns only."""
    message = decoder(F.expr(unframe(value) if framed else value))
    decoded = records.select(message.alias("_flow")).select("_flow.*")
    return decoded.select(*[_as(f) for f in schema.FLOW.fields])


def _as(field: T.StructField):
    return F.col(field.name).cast(field.dataType).alias(field.name)


def readable_flows(flows: DataFrame) -> DataFrame:
    """Messages with text addresses and timestamps, for a console."""
    from weirmark.functions import ip, timeslot

    addresses = ("dst_addr", "src_addr", "sampler_address", "next_hop")
    texts = ip.with_ip_text(
        flows, {f"_{a}": (a, "etype" if a in ("dst_addr", "src_addr") else None) for a in addresses}
    )
    times = {
        f"time_{t}": F.expr(timeslot.from_nanos(f"time_{t}_ns"))
        for t in ("flow_start", "flow_end", "received")
    }
    return texts.withColumns({a: F.col(f"_{a}") for a in addresses} | times).select(
        *flows.columns, *times
    )


def to_console(flows: DataFrame, checkpoint: str, **trigger):
    """Debug sink: one JSON line per message."""
    lines = readable_flows(flows).select(F.to_json(F.struct("*")).alias("value"))
    writer = lines.writeStream.format("console").option("truncate", "false")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
