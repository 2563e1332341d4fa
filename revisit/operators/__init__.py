"""DataFrame operators over event histories."""
