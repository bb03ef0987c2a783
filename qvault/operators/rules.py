"""Rules of the detectors, as data: what each looks for and what a hit means. Users may bring their own (see sources.read_rules)."""

from __future__ import annotations

# The tables of this module.

#: Rules by language of the file: (language, rule, algorithm, category, severity, quantum risk, specificity, pattern); letters of either case match.
LANGUAGE_RULES = [
    ("cpp", "cpp-openssl-md5", "MD5", "hash", "High", "Classical Risk", 3, r"MD5_Init|MD5_Update|MD5_Final|EVP_md5\s*\("),
    ("cpp", "cpp-openssl-sha1", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"SHA1_Init|SHA1_Update|SHA1_Final|EVP_sha1\s*\("),
    ("cpp", "cpp-openssl-des", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"DES_ncbc_encrypt|DES_ecb_encrypt|EVP_des_\w+\s*\("),
    ("cpp", "cpp-openssl-rsa-broken", "RSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"RSA_generate_key|EVP_PKEY_CTX_new_id\s*\(\s*EVP_PKEY_RSA"),
    ("csharp", "csharp-md5-crypto", "MD5", "hash", "High", "Classical Risk", 3, r"MD5(?:CryptoServiceProvider)?\.Create\s*\(|new\s+MD5CryptoServiceProvider\s*\("),
    ("csharp", "csharp-sha1-crypto", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"SHA1(?:CryptoServiceProvider)?\.Create\s*\(|new\s+SHA1CryptoServiceProvider\s*\("),
    ("csharp", "csharp-des-cipher", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"DESCryptoServiceProvider|TripleDESCryptoServiceProvider|DES\.Create\s*\("),
    ("csharp", "csharp-ecb-mode", "AES-ECB", "symmetric-cipher", "High", "Classical Risk", 4, r"CipherMode\.ECB"),
    ("csharp", "csharp-rsa-quantum-broken", "RSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"RSA\.Create\s*\(|new\s+RSACryptoServiceProvider\s*\("),
    ("go", "go-md5-hash", "MD5", "hash", "High", "Classical Risk", 3, r"md5\.(?:New|Sum)"),
    ("go", "go-sha1-hash", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"sha1\.(?:New|Sum)"),
    ("go", "go-des-cipher", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"des\.New(?:TripleDESCipher|Cipher)"),
    ("go", "go-rsa-quantum-broken", "RSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"rsa\.GenerateKey|rsa\.Encrypt|rsa\.Sign"),
    ("go", "go-ecdsa-quantum-broken", "ECDSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"ecdsa\.GenerateKey|ecdsa\.Sign"),
    ("java", "java-md5-digest", "MD5", "hash", "High", "Classical Risk", 3, r"""MessageDigest\.getInstance\s*\(\s*["']MD5["']"""),
    ("java", "java-sha1-digest", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"""MessageDigest\.getInstance\s*\(\s*["']SHA-?1["']"""),
    ("java", "java-des-cipher", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"""Cipher\.getInstance\s*\(\s*["']DES(?:/|["'])"""),
    ("java", "java-ecb-mode", "AES-ECB", "symmetric-cipher", "High", "Classical Risk", 4, r"""Cipher\.getInstance\s*\(\s*["'][^"']+/ECB/[^"']*["']"""),
    ("java", "java-rsa-small-key", "RSA-1024", "asymmetric", "Critical", "Quantum-Broken", 4, r"""KeyPairGenerator.*initialize\s*\(\s*1024"""),
    ("java", "java-rsa-quantum-broken", "RSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"""KeyPairGenerator\.getInstance\s*\(\s*["']RSA["']"""),
    ("kotlin", "kotlin-md5-digest", "MD5", "hash", "High", "Classical Risk", 3, r"""MessageDigest\.getInstance\s*\(\s*["']MD5["']"""),
    ("kotlin", "kotlin-des-cipher", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"""Cipher\.getInstance\s*\(\s*["']DES(?:/|["'])"""),
    ("php", "php-md5-hash", "MD5", "hash", "High", "Classical Risk", 3, r"""\bmd5\s*\(|hash\s*\(\s*['"]md5['"]"""),
    ("php", "php-sha1-hash", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"""\bsha1\s*\(|hash\s*\(\s*['"]sha1['"]"""),
    ("php", "php-des-mcrypt", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"""mcrypt_encrypt|openssl_encrypt\s*\([^,]+,\s*['"]DES"""),
    ("ruby", "ruby-md5-digest", "MD5", "hash", "High", "Classical Risk", 3, r"OpenSSL::Digest::MD5|Digest::MD5"),
    ("ruby", "ruby-sha1-digest", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"OpenSSL::Digest::SHA1|Digest::SHA1"),
    ("ruby", "ruby-des-cipher", "DES", "symmetric-cipher", "Critical", "Classical Risk", 4, r"""OpenSSL::Cipher::DES|OpenSSL::Cipher\.new\s*\(\s*['"]DES"""),
    ("rust", "rust-md5-hash", "MD5", "hash", "High", "Classical Risk", 3, r"md-5|md5::Md5|Md5::new"),
    ("rust", "rust-sha1-hash", "SHA-1", "hash", "Medium", "Classical Risk", 3, r"sha-1|sha1::Sha1|Sha1::new"),
    ("rust", "rust-rsa-quantum-broken", "RSA", "asymmetric", "Critical", "Quantum-Broken", 3, r"RsaPrivateKey::new|rsa::RsaPrivateKey"),
]

_PROTOCOLS = r"(?i)\b(?:SSLv2|SSLv3|TLSv1\.0|TLSv1\.1|TLSv1(?![.\d]))\b"
_CIPHERS = r"(?i)\b(RC4|DES|3DES|DES-CBC3|MD5|NULL|EXPORT|ADH|AECDH)\b"
#: Directives of web servers whose value names weak protocols or ciphers: (rule, severity, directive with its value, weak part).
WEB_DIRECTIVES = [
    ("nginx-weak-protocol", "High", r"(?i)^\s*ssl_protocols\s+([^;]+);", _PROTOCOLS),
    ("nginx-weak-cipher", "High", r"(?i)^\s*ssl_ciphers\s+([^;]+);", _CIPHERS),
    ("apache-weak-protocol", "High", r"(?i)^\s*SSLProtocol\s+(.+)$", _PROTOCOLS),
    ("apache-weak-cipher", "High", r"(?i)^\s*SSLCipherSuite\s+(.+)$", _CIPHERS),
    ("haproxy-weak-cipher", "High", r"(?i)^\s*(?:ssl-default-bind-ciphers|ciphers)\s+([^#\n]+)", _CIPHERS),
    ("haproxy-weak-protocol", "High", r"(?i)^\s*(?:ssl-default-bind-options|options)\s+([^#\n]+)", _PROTOCOLS),
]
#: The same of remote shells and of tunnels.
SHELL_DIRECTIVES = [
    ("ssh-weak-kex", "High", r"(?i)^[ \t]*KexAlgorithms[ \t]+([^\n#]+)", r"(?i)diffie-hellman-group1-sha1|diffie-hellman-group14-sha1|gss-gex-sha1|gss-group1-sha1"),
    ("ssh-weak-cipher", "High", r"(?i)^[ \t]*Ciphers[ \t]+([^\n#]+)", r"(?i)3des-cbc|blowfish-cbc|cast128-cbc|arcfour|arcfour128|arcfour256|aes128-cbc|aes192-cbc|aes256-cbc"),
    ("ssh-weak-mac", "Medium", r"(?i)^[ \t]*MACs[ \t]+([^\n#]+)", r"(?i)hmac-md5|hmac-sha1(?!-etm)|hmac-ripemd160|umac-64(?!@)"),
    ("ssh-weak-host-key", "Medium", r"(?i)^[ \t]*(?:HostKeyAlgorithms|PubkeyAcceptedAlgorithms|CASignatureAlgorithms)[ \t]+([^\n#]+)", r"(?i)ssh-dss|ssh-rsa(?!-sha2)"),
    ("ipsec-ikev1", "High", r"(?i)^[ \t]*(?:keyexchange|ikeversion)[ \t]*=[ \t]*([^\n#]+)", r"(?i)^ikev?1"),
    ("ipsec-weak-ike", "High", r"(?i)^[ \t]*ike[ \t]*=[ \t]*([^\n#]+)", r"(?i)3des|des|md5|sha1(?!96)|modp768|modp1024|modp1536"),
    ("ipsec-weak-esp", "High", r"(?i)^[ \t]*esp[ \t]*=[ \t]*([^\n#]+)", r"(?i)3des|des|md5|sha1(?!96)|modp768|modp1024|modp1536"),
]

#: Verification that is switched off: (rule, severity, pattern).
TLS_DISABLED = [
    ("node-tls", "High", r"""(?i)NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']?0["']?"""),
    ("curl-insecure", "High", r"(?i)\bcurl\b[^\n]*(?:-k\b|--insecure\b)"),
    ("wget-no-check", "High", r"(?i)\bwget\b[^\n]*--no-check-certificate\b"),
    ("pip-trusted-host", "High", r"(?i)\bpip\b[^\n]*--trusted-host\b"),
    ("verify-disabled", "High", r"(?i)\b(?:verify|ssl|rejectUnauthorized|tls_verify)\s*:\s*false\b"),
    ("insecure-skip-verify", "High", r"(?i)\bInsecureSkipVerify\s*:\s*true\b"),
]
#: Keys that a service or hardware holds; the first pattern of a line counts.
KEY_CUSTODY = [
    ("kms-hsm-aws-kms", "Informational", r"""(?i)\b(?:boto3\.client\(['"]kms['"]\)|boto3\.Session\(\)\.client\(['"]kms['"]\)|aws_kms_key|aws_kms_alias)\b"""),
    ("kms-hsm-azure-key-vault", "Informational", r"(?i)\b(?:KeyClient|SecretClient|azure_key_vault|vault\.azure\.net)\b"),
    ("kms-hsm-gcp-cloud-kms", "Informational", r"(?i)\b(?:KeyManagementServiceClient|google_kms_crypto_key|cloudkms\.googleapis\.com)\b"),
    ("hardware-module-pkcs11", "Informational", r"(?i)\b(?:PyKCS11|pkcs11|pkcs11js|libsofthsm2\.so|libCryptoki|C_Initialize|C_OpenSession|node-webcrypto-p11)\b"),
    ("hardware-module-tpm2", "Informational", r"(?i)\b(?:tpm2-tools|tss2|tpm2_createprimary|tpm2_evictcontrol|tpm2_pytss)\b|/dev/tpm(?:rm)?0\b"),
    ("hardware-module-token", "Informational", r"(?i)\b(?:pyscard|smartcard|yubikey|nitrokey|libopensc|opensc-pkcs11)\b"),
]
#: Factories that name a weak algorithm: (rule, the call with the name, names by severity, and what to use instead).
FACTORIES = [
    ("java-messagedigest-weak", r"""(?i)MessageDigest\.getInstance\s*\(\s*["'](MD5|SHA-?1)["']""", "SHA-256 or SHA-3"),
    ("java-cipher-weak", r"""(?i)Cipher\.getInstance\s*\(\s*["']([^"']*(?:DES|RC4|RC2|BLOWFISH|AES/ECB|AES/CBC)[^"']*)["']""", "AES-256-GCM"),
    ("java-mac-weak", r"""(?i)Mac\.getInstance\s*\(\s*["'](HmacMD5|HmacSHA1)["']""", "HmacSHA256"),
    ("cryptojs-hmac-weak", r"(?i)CryptoJS\.Hmac(MD5|SHA1|SHA224|SHA384)\s*\(", "HMAC-SHA256"),
]

#: Base images and service images that are out of support, and packages of cryptography with severity and risk.
LEGACY_BASES = ["ubuntu:14", "ubuntu:16", "debian:8", "centos:6", "node:10", "python:2.7"]
LEGACY_SERVICES = ["redis:3", "postgres:9", "mysql:5.5", "mongo:3"]
PACKAGES = {
    "openssl": ("High", "Classical Risk"), "libssl-dev": ("Medium", "Classical Risk"), "libssl": ("Medium", "Classical Risk"), "gnutls-bin": ("Medium", "Classical Risk"), "libgnutls28-dev": ("Medium", "Classical Risk"),
    "pycryptodome": ("Medium", "Quantum-Weakened"), "cryptography": ("Informational", "Quantum-Weakened"), "crypto-js": ("High", "Classical Risk"), "libsodium-dev": ("Informational", "Safe"), "libsodium23": ("Informational", "Safe"),
    "argon2-cffi": ("Informational", "Safe"), "bcrypt": ("Informational", "Safe"),
}

#: Library and symbol names in the printable strings of binaries: (rule, severity, pattern).
BINARY_NAMES = [
    ("openssl-legacy", "High", r"(?i)OpenSSL\s+(0\.[0-9]+\.[0-9]+|1\.0\.[0-9]+|1\.1\.0[a-z]?)"),
    ("openssl", "Informational", r"(?i)OpenSSL\s+(1\.1\.1[a-z]?|3\.[0-9]+\.[0-9]+)"),
    ("mbedtls", "Informational", r"(?i)mbedTLS\s+([0-9\.]+)"),
    ("gnutls", "Informational", r"(?i)GnuTLS\s+([0-9\.]+)"),
    ("bouncycastle", "Informational", r"(?i)BouncyCastle"),
    ("symbol-md5", "Critical", r"(?i)\b(?:MD5_Init|MD5_Update|MD5_Final|md5_hash)\b"),
    ("symbol-sha1", "High", r"(?i)\b(?:SHA1_Init|SHA1_Update|SHA1_Final|sha1_hash)\b"),
    ("symbol-des", "Critical", r"(?i)\b(?:DES_ecb_encrypt|DES_ncbc_encrypt|DES_set_key)\b"),
    ("symbol-rc4", "Critical", r"(?i)\b(?:RC4_set_key|RC4_encrypt|RC4_bytes)\b"),
]
PRINTABLE = r"[A-Za-z0-9_\-.:/=+%$@]{6,}"
BINARY_ENTROPY, BINARY_LENGTH = 4.3, 16

#: Calls: (rule, severity, category, last parts of the call's name, pattern that its arguments must hold or none).
CALL_RULES = [
    ("md5-hashing", "Critical", "hash", ["hashlib.md5", "hashes.MD5", "MD5.new"], None),
    ("sha1-hashing", "High", "hash", ["hashlib.sha1", "hashes.SHA1", "SHA1.new"], None),
    ("named-weak-hash", "High", "hash", ["hashlib.new", "crypto.createHash", "createHash"], r"""["'](md5|sha1|sha-1|ripemd160)["']"""),
    ("named-weak-hmac", "High", "hash", ["crypto.createHmac", "createHmac"], r"""["'](md5|sha1)["']"""),
    ("hmac-weak", "High", "hash", ["hmac.new"], r"(?i)\b(md5|sha1)\b"),
    ("ecb-mode", "Critical", "symmetric-cipher", ["AES.new", "DES.new", "DES3.new", "Cipher"], r"MODE_ECB|modes\.ECB"),
    ("des-cipher", "Critical", "symmetric-cipher", ["DES.new", "DES3.new", "algorithms.TripleDES"], None),
    ("rc4-cipher", "Critical", "symmetric-cipher", ["ARC4.new", "RC4.new", "algorithms.ARC4"], None),
    ("named-weak-cipher", "Critical", "symmetric-cipher", ["crypto.createCipheriv", "crypto.createCipher", "createCipheriv", "createCipher"], r"""(?i)["'](des|rc4|rc2|bf|[\w-]*ecb)[\w-]*["']"""),
    ("fernet-aes128-cbc-hmac", "Medium", "symmetric-cipher", ["Fernet"], None),
    ("rsa-keygen", "Critical", "asymmetric", ["RSA.generate", "rsa.generate_private_key", "rsa.newkeys"], None),
    ("named-keygen", "Critical", "asymmetric", ["crypto.generateKeyPair", "crypto.generateKeyPairSync", "generateKeyPairSync"], r"""["'](rsa|ec|dsa|dh)["']"""),
    ("ec-keygen", "Critical", "asymmetric", ["ec.generate_private_key", "ECC.generate"], None),
    ("dsa-keygen", "Critical", "asymmetric", ["DSA.generate", "dsa.generate_private_key"], None),
    ("weak-random", "High", "rng", ["random.random", "random.randint", "random.choice", "Math.random"], None),
    ("csprng-safe", "Informational", "rng", ["secrets.token_hex", "secrets.token_urlsafe", "secrets.token_bytes", "os.urandom", "crypto.randomBytes"], None),
    ("constant-time-compare-safe", "Informational", "comparison", ["hmac.compare_digest", "crypto.timingSafeEqual"], None),
]
#: Comparisons that leak by their time.
COMPARISON = r"(?i)\b\w*(signature|digest|hmac|token|secret|password)\w*\s*(==|!=)=?\s*\w"
