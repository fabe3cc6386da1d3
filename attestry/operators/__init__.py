"""DataFrame operators over claims, testimony, containment, text and graphs."""
