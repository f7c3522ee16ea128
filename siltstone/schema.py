"""Row types of a file inventory."""

from pyspark.sql import types as T

#: One file. Times are nanoseconds since 1970 (equality is to the nanosecond). mode has POSIX permission bits and, as type bits, DIR and LINK.
ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("mode", T.LongType(), False),
        T.StructField("uid", T.LongType(), False),
        T.StructField("gid", T.LongType(), False),
        T.StructField("dev", T.LongType(), False),
        T.StructField("ino", T.LongType(), False),
        T.StructField("ctime_ns", T.LongType(), False),
        T.StructField("mtime_ns", T.LongType(), False),
        T.StructField("is_deleted", T.BooleanType(), False),
        T.StructField("hash_type", T.LongType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("context", T.StringType(), False),
    ]
)
COLUMNS = ENTRY.fieldNames()
SECOND = 1_000_000_000

# Fixed values of the inventory format.
DIR, LINK = 1 << 31, 1 << 27
SETUID, SETGID, STICKY = 1 << 23, 1 << 22, 1 << 20
HASH_NAMES = {1: "sha1", 2: "sha256", 3: "sha512"}
HASH_SIZES = {1: 20, 2: 32, 3: 64}
MAX_FILE_SIZE, MAX_PATH = 1 << 62, 4096
DEVICE, NAMED_PIPE, SOCKET, CHAR_DEVICE = 1 << 26, 1 << 25, 1 << 24, 1 << 21
