"""Part of clauseloom; see README.md."""
