"""Ed25519 signatures by the JVM that Spark runs on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _key(spark: SparkSession, encoded: bytes, private: bool):
    jvm = spark.sparkContext._jvm
    factory = jvm.java.security.KeyFactory.getInstance("Ed25519")
    if private:
        return factory.generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(encoded)))
    return factory.generatePublic(jvm.java.security.spec.X509EncodedKeySpec(bytearray(encoded)))


def key_pair(spark: SparkSession) -> tuple[bytes, bytes]:
    """A new private and public key, encoded."""
    jvm = spark.sparkContext._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = jvm.java.security.KeyFactory.getInstance("Ed25519")
    spec = lambda name: jvm.java.lang.Class.forName(f"java.security.spec.{name}EncodedKeySpec")
    private = factory.getKeySpec(pair.getPrivate(), spec("PKCS8")).getEncoded()
    return bytes(private), bytes(factory.getKeySpec(pair.getPublic(), spec("X509")).getEncoded())


def sign(spark: SparkSession, content: bytes, private_key: bytes) -> str:
    signer = spark.sparkContext._jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(_key(spark, private_key, True))
    signer.update(bytearray(content))
    return bytes(signer.sign()).hex()


def verify(spark: SparkSession, content: bytes, signature: str, public_key: bytes) -> bool:
    verifier = spark.sparkContext._jvm.java.security.Signature.getInstance("Ed25519")
    verifier.initVerify(_key(spark, public_key, False))
    verifier.update(bytearray(content))
    try:
        return bool(verifier.verify(bytearray(bytes.fromhex(signature))))
    except Exception:  # a signature of another length
        return False
