"""Tables, blobs and the fetch stage."""
